"""Cell algebra and random independent sets."""

from pyspark.sql import functions as F

from panelweave.operators import cells, independent
from panelweave.plans.registry import query, rounded, table
from panelweave.plans.standins import BOXES, POINTS, box_edges, boxes, points
from panelweave.session import cut_lineage

# nation frames: a 5 x 5 grid of rectangles 72 x 34
FRAMES = """frames AS (SELECT n_nationkey AS owner, CAST(n_nationkey % 5 * 72 - 180 AS DOUBLE) AS x0, CAST(n_nationkey // 5 * 34 - 85 AS DOUBLE) AS y0 FROM nation),
  fcells AS (SELECT owner, CAST(x0 AS BIGINT) + i AS cx, CAST(y0 AS BIGINT) + j AS cy FROM frames, (SELECT unnest(range(72)) AS i), (SELECT unnest(range(34)) AS j))"""
CELLS = f"""{BOXES}, cells AS (SELECT geom_id, nation, x AS cx, y AS cy FROM (
  SELECT geom_id, nation, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS x, y0, y1 FROM boxes), LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS y))"""


def _frames(spark, d):
    k = F.col("n_nationkey")
    f = table(spark, d, "nation").select(
        k.alias("geom_id"), (k % 5 * 72 - 180).cast("double").alias("x0"), (F.floor(k / 5) * 34 - 85).cast("double").alias("y0")
    )
    f = f.withColumn("x1", F.col("x0") + 72).withColumn("y1", F.col("y0") + 34)
    return cells.fill_polygons(box_edges(f), 1.0).withColumnRenamed("geom_id", "owner")


def _cells(spark, d):
    b = boxes(spark, d)
    return cells.fill_polygons(box_edges(b), 1.0).join(b.select("geom_id", "nation"), "geom_id")


@query("filled_polygons", f"WITH {CELLS} SELECT geom_id, count(*) AS n, min(cx) AS x_min, max(cy) AS y_max FROM cells GROUP BY 1")
def filled_polygons(spark, d):
    return _cells(spark, d).groupBy("geom_id").agg(F.count(F.lit(1)).alias("n"), F.min("cx").alias("x_min"), F.max("cy").alias("y_max"))


@query("overlay_split", f"WITH {CELLS}, {FRAMES} SELECT geom_id, nation, owner, count(*) * 4.0 AS area FROM cells JOIN fcells USING (cx, cy) GROUP BY 1, 2, 3")
def overlay_split(spark, d):
    return cells.overlay_area(_cells(spark, d), _frames(spark, d), ["geom_id", "nation", "owner"], 4.0)


@query(
    "main_owner",
    f"""WITH {CELLS}, {FRAMES}, o AS (SELECT geom_id, owner, CAST(count(*) AS DOUBLE) AS overlap_area FROM cells JOIN fcells USING (cx, cy) GROUP BY 1, 2)
       SELECT geom_id, owner, overlap_area FROM (SELECT *, rank() OVER (PARTITION BY geom_id ORDER BY overlap_area DESC) AS r FROM o) WHERE r = 1""",
)
def main_owner(spark, d):
    return cells.main_owner(_cells(spark, d), _frames(spark, d), "geom_id", "owner", 1.0)


@query("dissolved_areas", f"WITH {CELLS} SELECT nation, CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT nation, cx, cy FROM cells) GROUP BY 1")
def dissolved_areas(spark, d):
    return cells.areas(cells.dissolve(_cells(spark, d), ["nation"]), ["nation"], 1.0)


@query(
    "area_difference",
    f"WITH {CELLS}, {FRAMES} SELECT geom_id, CAST(count(*) AS DOUBLE) AS area FROM cells c WHERE NOT EXISTS (SELECT 1 FROM fcells f WHERE f.owner = c.nation AND f.cx = c.cx AND f.cy = c.cy) GROUP BY 1",
)
def area_difference(spark, d):
    own = _frames(spark, d).withColumnRenamed("owner", "nation")
    return cells.areas(cells.difference(_cells(spark, d), own, ["nation"]), ["geom_id"], 1.0)


@query(
    "buffered_areas",
    f"""WITH {CELLS}, off AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4)
       SELECT geom_id, CAST(count(DISTINCT (cx + i, cy + j)) AS DOUBLE) AS area FROM cells, off GROUP BY 1""",
)
def buffered_areas(spark, d):
    return cells.areas(cells.dilate(_cells(spark, d), ["geom_id"], 2), ["geom_id"], 1.0)


@query(
    "polygon_meets_lines",
    f"""WITH {CELLS}, {POINTS}, r AS (SELECT DISTINCT CAST(floor(lon) AS BIGINT) AS cx, CAST(floor(lat) AS BIGINT) AS cy FROM points WHERE value > 5000)
       SELECT geom_id, geom_id IN (SELECT geom_id FROM cells JOIN r USING (cx, cy)) AS river FROM boxes""",
)
def polygon_meets_lines(spark, d):
    r = cells.cells_of_points(points(spark, d).where(F.col("value") > 5000), 1.0, [], "lon", "lat")
    return cells.meets(boxes(spark, d).select("geom_id"), _cells(spark, d), r, "geom_id", "river")


@query(
    "candidates_without_contact",
    f"""WITH {CELLS}, {POINTS}, r AS (SELECT DISTINCT CAST(floor(lon) AS BIGINT) AS cx, CAST(floor(lat) AS BIGINT) AS cy FROM points)
       SELECT geom_id FROM boxes WHERE geom_id NOT IN (SELECT geom_id FROM cells JOIN r USING (cx, cy))""",
)
def candidates_without_contact(spark, d):
    r = cells.cells_of_points(points(spark, d), 1.0, [], "lon", "lat")
    return cells.without_contact(boxes(spark, d).select("geom_id"), _cells(spark, d), r, "geom_id")


@query(
    "boxes_without_contact",
    f"""WITH {CELLS}, r AS (SELECT DISTINCT cx, cy FROM cells WHERE nation < 3)
       SELECT geom_id FROM boxes WHERE geom_id NOT IN (SELECT geom_id FROM cells JOIN r USING (cx, cy))""",
)
def boxes_without_contact(spark, d):
    """Boxes that share no cell with those of three nations: some do, some do not."""
    c = _cells(spark, d)
    return cells.without_contact(boxes(spark, d).select("geom_id"), c, c.where("nation < 3"), "geom_id")


SEGMENTS = f"""{POINTS}, seg AS (SELECT DISTINCT segment, nation, CAST(floor(lon / 10) AS BIGINT) AS cx, CAST(floor(lat / 10) AS BIGINT) AS cy FROM points),
  contact AS (SELECT a.segment, least(a.nation, b.nation) AS nation_1, greatest(a.nation, b.nation) AS nation_2, a.cx, a.cy, b.cx AS cx2, b.cy AS cy2
  FROM seg a JOIN seg b ON a.segment = b.segment AND a.nation <> b.nation AND ((b.cx = a.cx + 1 AND b.cy = a.cy) OR (b.cx = a.cx AND b.cy = a.cy + 1)))"""


def _segments(spark, d):
    return cells.cells_of_points(points(spark, d), 10.0, ["segment", "nation"], "lon", "lat")


@query("shared_borders", f"WITH {SEGMENTS} SELECT segment, nation_1, nation_2, count(*) * 10.0 AS border_length FROM contact GROUP BY 1, 2, 3")
def shared_borders(spark, d):
    return cells.border_pairs(_segments(spark, d), "segment", "nation", 10.0)


@query(
    "river_borders",
    f"""WITH {SEGMENTS}, {BOXES}, riv AS (SELECT DISTINCT CAST(floor(x0 / 10) AS BIGINT) AS cx, CAST(floor(y0 / 10) AS BIGINT) AS cy FROM boxes WHERE geom_id % 9 = 0),
       side AS (SELECT segment, nation_1, nation_2, cx, cy FROM contact UNION SELECT segment, nation_1, nation_2, cx2, cy2 FROM contact),
       hit AS (SELECT DISTINCT segment, nation_1, nation_2 FROM side s JOIN riv r ON pow(s.cx - r.cx, 2) + pow(s.cy - r.cy, 2) <= 1)
       SELECT p.segment, p.nation_1, p.nation_2, h.segment IS NOT NULL AS has_river_border FROM (SELECT DISTINCT segment, nation_1, nation_2 FROM contact) p LEFT JOIN hit h
       ON p.segment = h.segment AND p.nation_1 = h.nation_1 AND p.nation_2 = h.nation_2""",
)
def river_borders(spark, d):
    riv = cells.cells_of_points(boxes(spark, d).where(F.col("geom_id") % 9 == 0), 10.0, [], "x0", "y0")
    return cells.border_meets(cells.border_contacts(_segments(spark, d), "segment", "nation"), riv, ["segment", "nation_1", "nation_2"], 1)


@query(
    "overlap_ratio",
    f"""WITH {CELLS}, per AS (SELECT cx, cy, count(DISTINCT geom_id) AS n, max(CAST(nation % 2 = 0 AS INTEGER)) AS m, max(CAST(nation % 3 = 0 AS INTEGER)) AS f FROM cells GROUP BY 1, 2)
       SELECT sum(m)::BIGINT AS cells, round(sum(CASE WHEN n >= 2 THEN m ELSE 0 END) / sum(m), 6) AS overlap_share,
       round(sum(CASE WHEN n >= 2 THEN m * f ELSE 0 END) / sum(m), 6) AS feasible_overlap_share FROM per""",
)
def overlap_ratio(spark, d):
    return rounded(cells.overlap_share(_cells(spark, d), "geom_id", F.col("nation") % 2 == 0, F.col("nation") % 3 == 0))


@query(
    "overlapping_pairs",
    f"WITH {BOXES} SELECT a.geom_id AS a, b.geom_id AS b FROM boxes a JOIN boxes b ON a.geom_id < b.geom_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1",
)
def overlapping_pairs(spark, d):
    return cells.overlap_edges(_cells(spark, d), "geom_id")


def _sets(spark, d):
    b = boxes(spark, d)
    c = cut_lineage(cells.fill_polygons(box_edges(b), 1.0))
    samples = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("sample_id"))
    return c, independent.independent_sets_of_cells(b.select("geom_id"), c, "geom_id", samples, order=lambda s, k: (k * 7919 + s * 104729) % 1000003)


@query(
    "random_independent_sets",
    f"""WITH RECURSIVE {BOXES}, e AS (SELECT a.geom_id AS a, b.geom_id AS b FROM boxes a JOIN boxes b ON a.geom_id <> b.geom_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
       nb AS (SELECT a, list(b) AS near FROM e GROUP BY 1),
       ord AS (SELECT r_regionkey + 1 AS s, geom_id, coalesce(near, []) AS near, row_number() OVER (PARTITION BY r_regionkey ORDER BY (geom_id * 7919 + (r_regionkey + 1) * 104729) % 1000003, geom_id) AS o
         FROM region, boxes LEFT JOIN nb ON nb.a = geom_id),
       g AS (SELECT s, CAST(0 AS BIGINT) AS o, CAST([] AS BIGINT[]) AS kept FROM ord WHERE o = 1
         UNION ALL SELECT g.s, ord.o, CASE WHEN list_has_any(g.kept, ord.near) THEN g.kept ELSE list_append(g.kept, ord.geom_id) END FROM g JOIN ord ON ord.s = g.s AND ord.o = g.o + 1)
       SELECT s AS sample_id, unnest(kept) AS geom_id FROM g WHERE o = (SELECT max(o) FROM ord)""",
)
def random_independent_sets(spark, d):
    """The greedy sets themselves, on an order that both engines can compute."""
    return _sets(spark, d)[1]


@query(
    "independent_set_check",
    "SELECT r_regionkey + 1 AS sample_id, CAST(0 AS BIGINT) AS overlapping_pairs, (SELECT count(*) FROM supplier) AS kept_or_covered FROM region",
)
def independent_set_check(spark, d):
    """Per set: kept pairs that overlap (none), units kept or overlapping a kept one (all)."""
    c, s = _sets(spark, d)
    s = cut_lineage(s)
    at = c.join(s.hint("merge"), "geom_id")  # a row for each sample that keeps the area
    held = at.groupBy("sample_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    bad = at.join(held.where("n > 1"), ["sample_id", "cx", "cy"], "left_semi").select("sample_id", "geom_id").distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("overlapping_pairs"))
    near = held.groupBy("cx", "cy").agg(F.collect_set("sample_id").alias("s"))
    reach = c.join(cut_lineage(near).hint("merge"), ["cx", "cy"]).select("geom_id", F.explode("s").alias("sample_id")).distinct()
    cov = reach.unionByName(s).distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("kept_or_covered"))
    return cov.join(bad, "sample_id", "left").select("sample_id", F.coalesce("overlapping_pairs", F.lit(0)).alias("overlapping_pairs"), "kept_or_covered")
