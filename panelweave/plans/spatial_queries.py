"""Points, polygons, nearest features, look-alike search, neighbour counts."""

import math

from pyspark.sql import functions as F

from panelweave.functions import nulls, projection
from panelweave.operators import lines, spatial
from panelweave.plans.registry import query, rounded, table
from panelweave.plans.standins import BOX_EDGES, BOXES, POINTS, WELLS, box_edges, boxes, points, wells

_A = projection.WGS84_A

# the stand-in points and one point far off the map
_FAR = "spread AS (SELECT id, lon, lat FROM points UNION ALL SELECT -1, 9000.0, -200.0)"


def _far(p):
    away = p.sparkSession.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(9000.0).alias("x"), F.lit(-200.0).alias("y"))
    return p.select(F.col("id").cast("long").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y")).unionByName(away)


@query(
    "projected_points",
    f"""WITH {POINTS} SELECT id, round(radians(lon) * {_A!r}, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * {_A!r}, 3) + 0.0 AS y,
       round(radians(lon) * {projection.WGS84_A * projection._K0!r}, 3) + 0.0 AS ex,
       round(({1 - projection._E2!r} * (s / (1 - {projection._E2!r} * s * s) - ln((1 - {projection._E!r} * s) / (1 + {projection._E!r} * s)) / {2 * projection._E!r})) * {_A / (2 * projection._K0)!r}, 3) + 0.0 AS ey,
       round(lon, 6) + 0.0 AS lon2, round(lat, 6) + 0.0 AS lat2 FROM (SELECT *, sin(radians(lat)) AS s FROM points)""",
)
def projected_points(spark, d):
    p = points(spark, d).select(
        "id", projection.web_x("lon").alias("x"), projection.web_y("lat").alias("y"), projection.equal_area_x("lon").alias("ex"), projection.equal_area_y("lat").alias("ey")
    )
    p = p.withColumn("lon2", projection.lon_from_web("x")).withColumn("lat2", projection.lat_from_web("y"))
    return rounded(p, 3, lon2=6, lat2=6)


@query(
    "points_in_polygons",
    f"""WITH {POINTS}, {BOXES} SELECT id, geom_id, b.nation AS owner FROM points p LEFT JOIN boxes b
       ON abs(lon + 0.00371 - (x0 + x1) / 2) / ((x1 - x0) / 2) + abs(lat + 0.00173 - (y0 + y1) / 2) / ((y1 - y0) / 2) <= 1""",
)
def points_in_polygons(spark, d):
    """Left join of customers to the diamonds around suppliers."""
    p = points(spark, d).select("id", (F.col("lon") + 0.00371).alias("x"), (F.col("lat") + 0.00173).alias("y"))
    b = boxes(spark, d)
    return spatial.point_in_polygon(p, b.select("geom_id", F.col("nation").alias("owner")), box_edges(b, diamond=True), "id", 8.0).select("id", "geom_id", "owner")


@query(
    "points_in_boxes",
    f"WITH {POINTS}, {BOXES} SELECT id, geom_id FROM points JOIN boxes ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1",
)
def points_in_boxes(spark, d):
    p = points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.polygon_hits(p, box_edges(boxes(spark, d)), "id", 8.0)


_SEG = """sqrt(pow(px - (x1 + t * (x2 - x1)), 2) + pow(py - (y1 + t * (y2 - y1)), 2))"""
_T = "greatest(least(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 1.0), 0.0) AS t"


@query(
    "nearest_border_distance",
    f"""WITH {POINTS}, {BOXES}, {BOX_EDGES}, {_FAR}, j AS (SELECT id, lon AS px, lat AS py, x1, y1, x2, y2 FROM spread, box_edges), k AS (SELECT *, {_T} FROM j)
       SELECT id, round(min({_SEG}), 6) AS dist FROM k GROUP BY id""",
)
def nearest_border_distance(spark, d):
    n = spatial.nearest_segment(_far(points(spark, d)), box_edges(boxes(spark, d)), "id", ["geom_id"], 4.0)
    return rounded(n.select("id", "dist"))


@query(
    "nearest_fallback",
    f"""WITH {POINTS}, {BOXES}, {BOX_EDGES}, {_FAR}, hit AS (SELECT id, geom_id FROM spread JOIN boxes ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1),
       j AS (SELECT id, lon AS px, lat AS py, x1, y1, x2, y2, geom_id FROM spread, box_edges WHERE id NOT IN (SELECT id FROM hit)), k AS (SELECT *, {_T} FROM j),
       r AS (SELECT id, geom_id, {_SEG} AS dist FROM k), o AS (SELECT id, geom_id, row_number() OVER (PARTITION BY id ORDER BY dist, geom_id) AS o FROM r)
       SELECT id, geom_id, 'inside' AS "by" FROM hit UNION ALL SELECT id, geom_id, 'nearest' FROM o WHERE o = 1""",
)
def nearest_fallback(spark, d):
    p = _far(points(spark, d))
    e = box_edges(boxes(spark, d))
    found = spatial.covering_cells(e, 8.0)
    hits = spatial.polygon_hits(p, e, "id", 8.0, found=found)
    rest = spatial.outside_points(p, e, 8.0, found=found)
    return spatial.with_nearest_fallback(hits, p, e, "id", 4.0, rest).select("id", "geom_id", "by")


@query(
    "river_side_labels",
    f"""WITH {BOXES}, {BOX_EDGES}, riv AS (SELECT x0 + 7 AS x1, y0 + 5 AS y1, x1 + 7 AS x2, y1 + 5 AS y2 FROM boxes),
       j AS (SELECT geom_id, seq, (e.x1 + e.x2) / 2 AS px, (e.y1 + e.y2) / 2 AS py, r.x1, r.y1, r.x2, r.y2 FROM box_edges e, riv r), k AS (SELECT *, {_T} FROM j)
       SELECT geom_id, seq, CAST(bool_or({_SEG} <= 1.7) AS INTEGER) AS LB_river FROM k GROUP BY 1, 2""",
)
def river_side_labels(spark, d):
    b = boxes(spark, d)
    e = box_edges(b).withColumn("seg", F.col("geom_id") * 4 + F.col("seq"))
    riv = b.select((F.col("x0") + 7).alias("x1"), (F.col("y0") + 5).alias("y1"), (F.col("x1") + 7).alias("x2"), (F.col("y1") + 5).alias("y2"))
    return spatial.label_near(e, riv, "seg", 1.7, "LB_river").select("geom_id", "seq", "LB_river")


# Outlines in the east-west and north-south direction near lines that run likewise: within a buffer in closed form.
_ROADS = """roads AS (SELECT x0 + 7 AS bx1, y0 + 5 AS by1, x0 + 7 AS bx2, y1 + 5 AS by2 FROM boxes UNION SELECT x0 - 2, y1 + 3, x1 - 2, y1 + 3 FROM boxes)"""


def _roads(b):
    up = b.select((F.col("x0") + 7).alias("x1"), (F.col("y0") + 5).alias("y1"), (F.col("x0") + 7).alias("x2"), (F.col("y1") + 5).alias("y2"))
    return up.unionByName(b.select((F.col("x0") - 2).alias("x1"), (F.col("y1") + 3).alias("y1"), (F.col("x1") - 2).alias("x2"), (F.col("y1") + 3).alias("y2"))).distinct()


@query(
    "lines_split_at_buffer",
    f"""WITH {BOXES}, {BOX_EDGES}, {_ROADS},
       j AS (SELECT geom_id, seq, x1 = x2 AS up, CASE WHEN x1 = x2 THEN x1 ELSE y1 END AS pos, CASE WHEN x1 = x2 THEN y1 ELSE x1 END AS s, CASE WHEN x1 = x2 THEN y2 ELSE x2 END AS e,
         CASE WHEN x1 = x2 THEN least(bx1, bx2) ELSE least(by1, by2) END AS c0, CASE WHEN x1 = x2 THEN greatest(bx1, bx2) ELSE greatest(by1, by2) END AS c1,
         CASE WHEN x1 = x2 THEN least(by1, by2) ELSE least(bx1, bx2) END AS l0, CASE WHEN x1 = x2 THEN greatest(by1, by2) ELSE greatest(bx1, bx2) END AS l1 FROM box_edges, roads),
       k AS (SELECT *, greatest(c0 - pos, pos - c1, 0) AS off FROM j),
       i AS (SELECT geom_id, seq, s, e, greatest(l0 - sqrt(2.89 - off * off), least(s, e)) AS a, least(l1 + sqrt(2.89 - off * off), greatest(s, e)) AS z FROM k WHERE off <= 1.7),
       o AS (SELECT *, max(z) OVER (PARTITION BY geom_id, seq ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i WHERE a < z),
       p AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY geom_id, seq ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS part FROM o),
       q AS (SELECT geom_id, seq, part, max(z) - min(a) AS len FROM p GROUP BY 1, 2, 3), r AS (SELECT geom_id, seq, count(*) AS n, sum(len) AS len FROM q GROUP BY 1, 2)
       SELECT b.geom_id, b.seq, coalesce(n, 0)::BIGINT AS near_pieces, round(coalesce(len, 0), 6) AS near_length, round(abs(x2 - x1) + abs(y2 - y1) - coalesce(len, 0), 6) + 0.0 AS far_length
       FROM box_edges b LEFT JOIN r ON r.geom_id = b.geom_id AND r.seq = b.seq""",
)
def lines_split_at_buffer(spark, d):
    b = boxes(spark, d)
    e = box_edges(b).withColumn("seg", F.col("geom_id") * 4 + F.col("seq"))
    cut = lines.split_near(e, _roads(b), "seg", 1.7)
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    of = lambda near: F.round(F.coalesce(F.sum(F.when(F.col("near") == near, length)), F.lit(0.0)), 6)
    per = cut.groupBy("seg").agg(F.count_if("near").alias("near_pieces"), of(True).alias("near_length"), of(False).alias("far_length"))
    return per.select(F.floor((F.col("seg")) / 4).alias("geom_id"), (F.col("seg") % 4).cast("int").alias("seq"), "near_pieces", "near_length", "far_length")


@query(
    "polygons_near_lines",
    f"""WITH {BOXES}, riv AS (SELECT geom_id AS l, x0 + 30 AS p1, y0 + 21 AS q1, x1 + 30 AS p2, y1 + 21 AS q2 FROM boxes WHERE geom_id % 3 = 0),
       j AS (SELECT geom_id, p1, q1, p2, q2, x0 - 2.5 AS a0, x1 + 2.5 AS a1, y0 AS b0, y1 AS b1, x0 AS c0, x1 AS c1, y0 - 2.5 AS d0, y1 + 2.5 AS d1, x0, x1, y0, y1 FROM boxes, riv),
       clip AS (SELECT geom_id, p1, q1, p2, q2, x0, x1, y0, y1,
         greatest(0, (a0 - p1) / (p2 - p1), (b0 - q1) / (q2 - q1)) <= least(1, (a1 - p1) / (p2 - p1), (b1 - q1) / (q2 - q1)) AS wide,
         greatest(0, (c0 - p1) / (p2 - p1), (d0 - q1) / (q2 - q1)) <= least(1, (c1 - p1) / (p2 - p1), (d1 - q1) / (q2 - q1)) AS tall FROM j),
       corner AS (SELECT *, unnest([x0, x0, x1, x1]) AS kx, unnest([y0, y1, y0, y1]) AS ky FROM clip),
       t AS (SELECT *, greatest(0, least(1, ((kx - p1) * (p2 - p1) + (ky - q1) * (q2 - q1)) / (pow(p2 - p1, 2) + pow(q2 - q1, 2)))) AS t FROM corner)
       SELECT DISTINCT geom_id FROM t WHERE wide OR tall OR sqrt(pow(kx - p1 - t * (p2 - p1), 2) + pow(ky - q1 - t * (q2 - q1), 2)) <= 2.5""",
)
def polygons_near_lines(spark, d):
    """Boxes within 2.5 of a slanted line, or around one: a box grown sideways, upwards and by its corners."""
    b = boxes(spark, d)
    riv = b.where("geom_id % 3 = 0").select((F.col("x0") + 30).alias("x1"), (F.col("y0") + 21).alias("y1"), (F.col("x1") + 30).alias("x2"), (F.col("y1") + 21).alias("y2"))
    return lines.polygons_meeting_lines(box_edges(b), riv, 2.5, 6.0)


@query(
    "nearest_river",
    f"""WITH {POINTS}, {BOXES}, {_FAR}, riv AS (SELECT geom_id, x0 + 7 AS x1, y0 + 5 AS y1, x1 + 7 AS x2, y1 + 5 AS y2 FROM boxes WHERE x0 > 60),
       j AS (SELECT id, geom_id, lon AS px, lat AS py, x1, y1, x2, y2 FROM spread, riv), k AS (SELECT *, {_T} FROM j), r AS (SELECT id, geom_id, {_SEG} AS dist FROM k),
       o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, geom_id) AS o FROM r) SELECT id, geom_id, round(dist, 6) AS dist FROM o WHERE o = 1""",
)
def nearest_river(spark, d):
    """Most points lie far from all lines, which are in the east only; the carried id is compared too."""
    riv = boxes(spark, d).where("x0 > 60").select("geom_id", (F.col("x0") + 7).alias("x1"), (F.col("y0") + 5).alias("y1"), (F.col("x1") + 7).alias("x2"), (F.col("y1") + 5).alias("y2"))
    return rounded(spatial.nearest_segment(_far(points(spark, d)), riv, "id", ["geom_id"], 4.0).select("id", "geom_id", "dist"))


@query(
    "polygon_centroids",
    f"""WITH {BOXES} SELECT geom_id, round((x0 + x1) / 2, 6) + 0.0 AS x, round((y0 + y1) / 2, 6) + 0.0 AS y, (x1 - x0) * (y1 - y0) / 2 AS area,
       round(2 * sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) AS perimeter FROM boxes""",
)
def polygon_centroids(spark, d):
    return rounded(spatial.polygon_centroids(box_edges(boxes(spark, d), diamond=True)))


@query(
    "snapped_edges",
    f"""WITH {BOXES}, {BOX_EDGES}, s AS (SELECT DISTINCT geom_id, round(x1 / 4) * 4 AS x1, round(y1 / 4) * 4 AS y1, round(x2 / 4) * 4 AS x2, round(y2 / 4) * 4 AS y2 FROM box_edges)
       SELECT geom_id, count(*) AS n FROM s WHERE x1 <> x2 OR y1 <> y2 GROUP BY 1""",
)
def snapped_edges(spark, d):
    return spatial.snap_edges(box_edges(boxes(spark, d)), 4.0).groupBy("geom_id").agg(F.count(F.lit(1)).alias("n"))


_LOOK = f"""{POINTS}, {BOXES},
  u AS (SELECT geom_id AS id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, (x1 - x0) * (y1 - y0) AS area FROM boxes),
  c AS (SELECT id, lon AS x, lat AS y, 1.0 + id % 500 AS area FROM points)"""


def _look(spark, d):
    u = boxes(spark, d).select(
        F.col("geom_id").alias("id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"),
        ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"),
    )
    c = points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("id") % 500 + 1.0).alias("area"))
    return u, c


@query("area_band_join", f"WITH {_LOOK} SELECT u.id AS u_id, count(*) AS n, sum(c.area) AS total FROM u JOIN c ON c.area BETWEEN u.area / 4 AND u.area * 4 GROUP BY 1")
def area_band_join(spark, d):
    u, c = _look(spark, d)
    return spatial.band_totals(u, c)


@query(
    "lookalike_candidates",
    f"""WITH {_LOOK} SELECT u.id AS u_id, c.id AS c_id, c.area AS c_area, round(sqrt(pow(u.x - c.x, 2) + pow(u.y - c.y, 2)), 6) AS dist FROM u JOIN c
       ON c.area BETWEEN u.area / 4 AND u.area * 4 AND sqrt(pow(u.x - c.x, 2) + pow(u.y - c.y, 2)) <= 25 + sqrt(u.area / pi())""",
)
def lookalike_candidates(spark, d):
    u, c = _look(spark, d)
    near = spatial.lookalike_candidates(u, c, radius=25.0, cell=15.0)
    return near.select("u_id", "c_id", "c_area", nulls.round_scaled("dist", 6).alias("dist"))


@query(
    "best_lookalikes",
    f"""WITH {_LOOK}, j AS (SELECT u.id AS u_id, c.id AS c_id, c.id % 3 = u.id % 3 AS same, round(sqrt(pow(u.x - c.x, 2) + pow(u.y - c.y, 2)), 6) AS dist FROM u JOIN c
       ON c.area BETWEEN u.area / 4 AND u.area * 4 AND sqrt(pow(u.x - c.x, 2) + pow(u.y - c.y, 2)) <= 25 + sqrt(u.area / pi()))
       SELECT u_id, c_id, same, dist FROM (SELECT *, row_number() OVER (PARTITION BY u_id ORDER BY same DESC, dist, c_id) AS r FROM j) WHERE r <= 40""",
)
def best_lookalikes(spark, d):
    """Up to 40 per unit: same group first, then the nearest of the rest."""
    u, c = _look(spark, d)
    return spatial.nearest_lookalikes(u, c, F.col("c_id") % 3 == F.col("u_id") % 3, 40, radius=25.0)


_NB = f"""{POINTS}, nb AS (SELECT a.id, a.nation, count(*) AS n, sum(0.75 * (1 - (pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) / 900.0)) / (pi() * 900.0) AS epan
  FROM points a JOIN points b ON a.nation = b.nation AND sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) <= 30.0 GROUP BY 1, 2)"""


def _pts(spark, d):
    return points(spark, d).select("id", "nation", F.col("lon").alias("x"), F.col("lat").alias("y"))


@query("neighbour_counts", f"WITH {_NB} SELECT id, n FROM nb")
def neighbour_counts(spark, d):
    return spatial.neighbours_within(_pts(spark, d), ["nation"], 30.0, "n").select("id", "n")


@query(
    "decluster_weights",
    f"""WITH {_NB}, q AS (SELECT nation, quantile_cont(1.0 / n, 0.99) AS cap FROM (SELECT nation, CAST(n AS DOUBLE) AS n FROM nb) GROUP BY 1),
       w AS (SELECT id, nb.nation, least(1.0 / n, cap) AS w FROM nb JOIN q ON nb.nation = q.nation)
       SELECT id, round(w / avg(w) OVER (PARTITION BY nation), 6) AS w FROM w""",
)
def decluster_weights(spark, d):
    return rounded(spatial.decluster_weights(_pts(spark, d), ["nation"], 30.0).select("id", "w"))


@query(
    "kernel_weights",
    f"""WITH {POINTS}, g AS (SELECT a.id, a.nation, sum(exp(-0.5 * (pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) / 100.0)) / (2 * pi() * 100.0) AS f
       FROM points a JOIN points b ON a.nation = b.nation GROUP BY 1, 2),
       q AS (SELECT nation, quantile_cont(1.0 / f, 0.99) AS cap FROM g GROUP BY 1), w AS (SELECT id, g.nation, least(1.0 / f, cap) AS w FROM g JOIN q ON g.nation = q.nation)
       SELECT id, round(w / avg(w) OVER (PARTITION BY nation), 6) AS w FROM w""",
)
def kernel_weights(spark, d):
    return rounded(spatial.decluster_weights(_pts(spark, d), ["nation"], 10.0, kernel="gaussian").select("id", "w"))


@query("epanechnikov_density", f"WITH {_NB} SELECT id, round(epan * 1000, 8) AS dens FROM nb")
def epanechnikov_density(spark, d):
    k = spatial.kernel_density(_pts(spark, d), ["nation"], 30.0, "epanechnikov")
    return k.select("id", F.round(F.col("dens") * 1000, 8).alias("dens"))
