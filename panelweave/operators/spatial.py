"""Point and segment operators on plain coordinates.

Every join below is an equi-join on grid cells followed by the exact predicate, so no plan
holds a nested-loop join. Coordinates are planar (project first); one point is one row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.operators import discs, gauss
from panelweave.operators.prefix import attach_group, attach_units, exact_quantiles, scan
from panelweave.operators.tables import top_rows
from panelweave.session import cut_lineage


def cell_of(c: Column | str, size: float | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x / size).cast("long")


def span(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi))


def around(c: Column | str, k: int = 1) -> Column:
    """The value and its k neighbours on either side, one row each."""
    x = F.col(c) if isinstance(c, str) else c
    return span(x - k, x + k)


def segment_distance(px: str, py: str) -> Column:
    """Distance from (px, py) to the segment x1,y1 - x2,y2 of the same row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    len2 = dx * dx + dy * dy
    along = (F.col(px) - F.col("x1")) * dx + (F.col(py) - F.col("y1")) * dy
    t = F.when(len2 > 0, F.least(F.greatest(along / len2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = F.col(px) - (F.col("x1") + t * dx), F.col(py) - (F.col("y1") + t * dy)
    return F.sqrt(ex * ex + ey * ey)


# ---- bundles: many pairs from few joined rows ------------------------------------------

# Rows of a bundle, strips that a cell is ordered by, and pairs that one key brings to one task.
BUNDLE_ROWS, STRIPS, TASK_PAIRS = 128, 8, 2_000_000_000
# Pairs beyond which a join of bundles is spread by their number; the rows joined say too little of them.
SPREAD_PAIRS = 100_000_000


def bundled(rows: DataFrame, keys: list[str], within: list[str], x: str, y: str, strip: float, more: dict[str, Column]) -> DataFrame:
    """Rows of equal `keys` and `within`, up to BUNDLE_ROWS neighbours in one: the keys, `__k` its number, `__n` rows, the box
    `__x0, __x1, __y0, __y1` around them, the aggregates `more`, and the rows as the array `__s`.

    Rows without a key are left out. They are put in order by ranges, so a crowded key is no one task's.
    """
    names = [c for c in rows.columns if c not in (*keys, *within)]
    order = [*keys, *within, cell_of(x, strip), F.col(y), F.xxhash64(*names)]
    known = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, *within)]))
    line = known.repartitionByRange(*order).sortWithinPartitions(*order)
    line = line.withColumn("__k", F.floor(F.monotonically_increasing_id() / BUNDLE_ROWS))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    box = {"__x0": F.min(real(x)), "__x1": F.max(real(x)), "__y0": F.min(real(y)), "__y1": F.max(real(y))} | more
    per = line.groupBy(*keys, *within, "__k").agg(
        F.count(F.lit(1)).alias("__n"), *[v.alias(k) for k, v in box.items()], F.collect_list(F.struct(*names)).alias("__s")
    )
    return cut_lineage(per.select(*keys, "__k", "__n", *box, "__s"))


def dealt(rows: DataFrame, bundles: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both, and the keys to join them on. The bundles of a key with more than TASK_PAIRS pairs are dealt to several tasks,
    each with a copy of the rows. Pairs may be many where rows are few, so many pairs get more partitions than rows would."""
    held = bundles.groupBy(*keys).agg(F.sum("__n").alias("__c"), F.count(F.lit(1)).alias("__m"))
    asked = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"))
    pairs = F.col("__c").cast("double") * F.col("__r")
    work = cut_lineage(asked.join(held.hint("merge"), keys).select(*keys, pairs.alias("pairs"), "__m"))
    total, most = (v or 0 for v in work.agg(F.sum("pairs"), F.max("pairs")).first())
    on = list(keys)
    if most > TASK_PAIRS:
        hot = work.where(F.col("pairs") > TASK_PAIRS).select(*keys, F.least(F.ceil(F.col("pairs") / TASK_PAIRS), "__m").alias("__parts"))
        parts = F.coalesce("__parts", F.lit(1).cast("long"))
        rows = rows.join(hot, keys, "left").withColumn("__p", span(F.lit(0).cast("long"), parts - 1)).drop("__parts")
        bundles = bundles.join(hot, keys, "left").withColumn("__p", F.pmod("__k", parts)).drop("__parts")
        on.append("__p")
    if total > SPREAD_PAIRS:
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(total // (TASK_PAIRS // 10)), 1000))
        rows, bundles = rows.repartition(n, *on), bundles.repartition(n, *on)
    return rows, bundles, on


# ---- points and polygons ---------------------------------------------------------------


def _turn(x: Column, y: Column, at=F.col) -> Column:
    """Sign: on which side of the edge `at` of the same row (x, y) lies."""
    return (at("x2") - at("x1")) * (y - at("y1")) - (at("y2") - at("y1")) * (x - at("x1"))


def _right_of(x: Column, y: Column, at=F.col) -> Column:
    """Does the edge's line meet the height y right of x?"""
    t, up = _turn(x, y, at), at("y2") - at("y1")
    return ((up > 0) & (t > 0)) | ((up < 0) & (t < 0))


def _above(x: Column, y: Column, at=F.col) -> Column:
    """Does the edge's line pass above (x, y)? One through the point does if it rises."""
    t, over = _turn(x, y, at), at("x2") - at("x1")
    return ((over > 0) & (t < 0)) | ((over < 0) & (t > 0)) | ((t == 0) & (over * (at("y2") - at("y1")) > 0))


def _straddles(v: Column, axis: str, at=F.col) -> Column:
    return (at(f"{axis}1") > v) != (at(f"{axis}2") > v)


def polygon_cells(edges: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """The cells of polygons: (geom_id, cx, cy, border, odd) and the edges in their border cells.

    A cell without an edge lies wholly inside (odd) or outside; cells outside are left out. For a
    border cell `odd` is the parity of the edges right of its lower left corner. Parities of all
    cells of a row come from one running sum over the row's crossings.
    """
    s = F.lit(float(cell))
    passed = cut_lineage(along_segment(edges.select("geom_id", "x1", "y1", "x2", "y2").where("x1 <> x2 OR y1 <> y2"), s))
    border = scan(passed.select("geom_id", "cx", "cy").distinct(), ["geom_id", "cy"], "cx", [], {"next": ("min", F.col("cx"), "before")}, descending=True)
    asks = border.select("geom_id", "cy", F.col("cx").alias("at"), F.lit(True).alias("border"), F.col("cx").alias("upto")).unionByName(
        border.where("next > cx + 1").select("geom_id", "cy", (F.col("cx") + 1).alias("at"), F.lit(False).alias("border"), (F.col("next") - 1).alias("upto"))
    )
    # an edge counts for all corners left of where it meets the lower line of the row
    lines = edges.select("geom_id", "x1", "y1", "x2", "y2").withColumn("cy", span(cell_of(F.least("y1", "y2"), s), cell_of(F.greatest("y1", "y2"), s)))
    lines = lines.where(_straddles(F.col("cy") * s, "y"))
    meets = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("cy") * s - F.col("y1")) / (F.col("y2") - F.col("y1"))
    near = lines.withColumn("c", cell_of(meets, s))
    last = [F.when(_right_of((F.col("c") + k) * s, F.col("cy") * s), F.col("c") + k) for k in (1, 0, -1)]  # rounding may be off by one
    events = near.select("geom_id", "cy", F.coalesce(*last, F.col("c") - 2).alias("at"), F.lit(1).alias("e"))
    both = events.unionByName(asks.withColumn("e", F.lit(0)), allowMissingColumns=True).withColumn("first", -F.col("e"))
    counted = scan(both, ["geom_id", "cy"], "at", ["first"], {"n": ("sum", F.col("e"), "upto")}, descending=True).where("e = 0")
    cells = counted.withColumn("odd", F.col("n") % 2 == 1).where("border OR odd")
    return cells.select("geom_id", "cy", "border", "odd", span(F.col("at"), F.col("upto")).alias("cx")), passed


def covering_cells(edges: DataFrame, cell: float, attrs: DataFrame | None = None) -> DataFrame:
    """The cells of `polygon_cells`, written: geom_id, __cx, __cy, __border, __odd, `attrs` by geom_id and, for a border
    cell, the edges that pass it."""
    found, passed = polygon_cells(edges, cell)
    per = passed.groupBy("geom_id", "cx", "cy").agg(F.collect_list(F.struct(*_ENDS)).alias("__edges"))
    found = found.join(per.hint("merge"), ["geom_id", "cx", "cy"], "left")
    if attrs is not None:
        found = found.join(attrs.hint("merge"), "geom_id")
    return cut_lineage(found.withColumnsRenamed({"cx": "__cx", "cy": "__cy", "border": "__border", "odd": "__odd"}))


_ENDS = ["x1", "y1", "x2", "y2"]


def _located(points: DataFrame, cell: float, x: str, y: str) -> DataFrame:
    return points.withColumns({"__px": F.col(x), "__py": F.col(y), "__cx": cell_of(x, cell), "__cy": cell_of(y, cell)})


def _edge(at, x0: Column, y0: Column) -> dict[str, Column]:
    """What the tests below ask of the edge `at` in the cell whose lower left corner is (x0, y0), apart from the point."""
    dx, dy = at("x2") - at("x1"), at("y2") - at("y1")
    up = _straddles(x0, "x", at) & _above(x0, y0, at)  # passes above the corner
    low, high = ({f"{k}{c}": f(at(f"{c}1"), at(f"{c}2")) for c in "xy"} for k, f in (("l", F.least), ("h", F.greatest)))
    own = {"x1": at("x1"), "y1": at("y1"), "y2": at("y2"), "dx": dx, "dy": dy, "sx": F.signum(dx), "sy": F.signum(dy)}
    return own | {"k0": dy * (x0 - at("x1")), "up": up, "rise": F.signum(dx) * F.signum(dy) > 0} | low | high


def _turns(e, px, py) -> Column:
    """Does the way from the corner of a border cell up its left side and along the point's height meet the edge once?"""
    t, t0 = e["dx"] * (py - e["y1"]) - e["dy"] * (px - e["x1"]), e["dx"] * (py - e["y1"]) - e["k0"]
    along = ((e["y1"] > py) != (e["y2"] > py)) & (e["sy"] * t0 > 0) & ~(e["sy"] * t > 0)
    return along != (e["up"] & ~((e["sx"] * t0 < 0) | ((t0 == 0) & e["rise"])))


def _on(e, px, py) -> Column:
    t = e["dx"] * (py - e["y1"]) - e["dy"] * (px - e["x1"])
    return (t == 0) & (px >= e["lx"]) & (px <= e["hx"]) & (py >= e["ly"]) & (py <= e["hy"])


def _few_hold(edges, px, py) -> Column:
    """Does a border cell with the named `edges` hold the point?"""
    odd = reduce(lambda n, e: n != _turns(e, px, py), edges, F.col("__odd"))
    return reduce(lambda a, e: a | _on(e, px, py), edges, odd)


def _many_hold(edge, px, py) -> Column:
    """The same for any number of edges, a walk over their array."""
    odd = F.aggregate("__edges", F.col("__odd"), lambda n, e: n != _turns(edge(e.__getitem__), px, py))
    return odd | F.exists("__edges", lambda e: _on(edge(e.__getitem__), px, py))


def _touches(e) -> Column:
    """May the edge meet the box of a bundle, its middle __mx, __my and half widths __wx, __wy? If not, its points lie alike."""
    a, b = e["dx"] * (F.col("__my") - e["y1"]), e["dy"] * (F.col("__mx") - e["x1"])
    near = F.abs(a - b) <= (F.abs(e["dx"]) * F.col("__wy") + F.abs(e["dy"]) * F.col("__wx")) + 1e-9 * (F.abs(a) + F.abs(b))  # a hair of slack
    return (e["hx"] >= F.col("__x0")) & (e["lx"] <= F.col("__x1")) & (e["hy"] >= F.col("__y0")) & (e["ly"] <= F.col("__y1")) & near


def _hits(points: DataFrame, found: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each point with each polygon that holds it, border included: columns of both, geom_id and the attributes of `found`.

    A cell of the grid lies inside a polygon, outside it, or on its border. In a border cell the parity at the cell's
    corner is carried to the point along the cell's left side and the point's height; only edges in the cell
    can cross that way, and they travel with it. Points come in bundles of neighbours: those of an inner cell, and those
    that no edge touches, are answered by one test or none; only the others are tested one by one. So every pair is decided
    where its cell is met, and bundles and cells are shuffled but not their pairs.
    """
    finite = (F.abs("__px") < float("inf")) & (F.abs("__py") < float("inf"))  # others are tested one by one
    one = {"__loose": F.max(~F.coalesce(finite, F.lit(False))), "__one": F.min(F.struct("__px", "__py"))}
    held = bundled(_located(points, cell, x, y), ["__cx", "__cy"], [], "__px", "__py", float(cell) / STRIPS, one)
    number = lambda c: F.coalesce(c, F.lit(float("nan")))  # never null, for shorter generated code
    held = held.withColumns({c: number(F.col(c)) for c in ("__x0", "__x1", "__y0", "__y1")})
    wide = lambda c: (F.col(f"__{c}1") - F.col(f"__{c}0")) / 2 * (1 + 1e-9) + 1e-12 * (F.abs(f"__{c}0") + F.abs(f"__{c}1"))
    middle = {f"__m{c}": (F.col(f"__{c}0") + F.col(f"__{c}1")) / 2 for c in "xy"} | {f"__w{c}": wide(c) for c in "xy"}
    held = held.withColumns({**middle, "__fx": number(F.col("__one.__px")), "__fy": number(F.col("__one.__py"))}).drop("__one")
    found, held, on = dealt(found, held, ["__cx", "__cy"])
    edge, (few, edges), many = _border_cells(found, cell)
    sides = [
        (few, reduce(lambda a, b: a | b, map(_touches, edges)), lambda *p: _few_hold(edges, *p)),
        (many, F.exists("__edges", lambda e: _touches(edge(e.__getitem__))), lambda *p: _many_hold(edge, *p)),
    ]
    given = [c for c in found.columns if not c.startswith("__")]
    rows = lambda met: met.select("*", F.inline("__s"))
    held = held.hint("shuffle_hash")
    out = [rows(found.where("NOT __border").join(held, on))]
    for cells, touch, holds in sides:
        met, touch = cells.join(held, on), F.col("__loose") | touch
        out.append(rows(met.where(~touch & holds(F.col("__fx"), F.col("__fy")))))
        out.append(rows(met.where(touch)).where(F.col("__px").isNotNull() & F.col("__py").isNotNull() & holds(F.col("__px"), F.col("__py"))))
    return reduce(lambda a, b: a.unionByName(b), [d.select(*points.columns, *given) for d in out])


def _border_cells(found: DataFrame, cell: float) -> tuple:
    """`_edge` of an edge in a border cell; border cells of one or two edges, as most have, and those; the other border cells.

    Two edges are named, which is several times faster than a walk over an array.
    """
    corner = F.col("__cx") * F.lit(float(cell)), F.col("__cy") * F.lit(float(cell))
    edge = lambda at: _edge(at, *corner)
    ends = {f"__{n}_{c}": F.coalesce(F.get("__edges", F.lit(i))[c], F.lit(float("nan"))) for i, n in enumerate("ab") for c in _ENDS}
    few = found.where("__border AND size(__edges) <= 2").withColumns(ends).drop("__edges")
    full = {n: edge(lambda c, n=n: F.col(f"__{n}_{c}")) for n in "ab"}
    few = few.withColumns({f"__{n}_{k}": v for n in "ab" for k, v in full[n].items()} | {"__odd": F.coalesce("__odd", F.lit(False))})
    return edge, (few, [{k: F.col(f"__{n}_{k}") for k in full[n]} for n in "ab"]), found.where("__border AND size(__edges) > 2")


def _misses(points: DataFrame, found: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """The points that no polygon holds, those without a place included."""
    edge, (few, edges), many = _border_cells(found, cell)
    p = F.col("__px"), F.col("__py")
    left = _located(points, cell, x, y)
    for cells, holds in ((found.where("NOT __border"), None), (few, _few_hold(edges, *p)), (many, _many_hold(edge, *p))):
        cells = cells.withColumnsRenamed({"__cx": "__x", "__cy": "__y"})
        same = (F.col("__cx") == F.col("__x")) & (F.col("__cy") == F.col("__y"))
        left = left.join(cells.hint("merge"), same if holds is None else same & holds, "left_anti")
    return left.drop("__px", "__py", "__cx", "__cy")


def polygon_hits(points: DataFrame, edges: DataFrame, point_id: str, cell: float, x: str = "x", y: str = "y", found: DataFrame | None = None) -> DataFrame:
    """(point_id, geom_id) for every polygon that holds the point, border included. `found` is `covering_cells`, if already made.

    Rows that share an id and a place are one point; places that share an id may answer for one another.
    """
    pts = cut_lineage(points.select(F.col(point_id), F.col(x).alias("px"), F.col(y).alias("py")).distinct())
    hits = _hits(pts, covering_cells(edges, cell) if found is None else found, cell, "px", "py").select(point_id, "geom_id")
    many = not pts.groupBy(point_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return hits.distinct() if many else hits


def outside_points(points: DataFrame, edges: DataFrame, cell: float, x: str = "x", y: str = "y", found: DataFrame | None = None) -> DataFrame:
    """The points that no polygon holds. `found` is `covering_cells`, if already made."""
    return _misses(points, covering_cells(edges, cell) if found is None else found, cell, x, y)


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, edges: DataFrame, point_id: str, cell: float, how: str = "left", x: str = "x", y: str = "y"
) -> DataFrame:
    """Attach polygon attributes to points; a point in several polygons gives several rows."""
    if how not in ("inner", "left", "left_anti"):
        raise ValueError(f"no {how} join of points and polygons")
    found = covering_cells(edges, cell, polygons)
    if how == "left_anti":
        return _misses(points, found, cell, x, y)
    hits = _hits(points, found, cell, x, y)
    if how == "inner":
        return hits
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in hits.schema.fields[len(points.columns) :]]
    return hits.unionByName(_misses(points, found, cell, x, y).select(*points.columns, *none))


def nearest_segment(
    points: DataFrame,
    edges: DataFrame,
    point_id: str,
    attrs: list[str],
    cell: float,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Nearest segment of each point: `dist` and the carried `attrs` (ties by attributes).

    Grids of size cell*4^k are laid over the segments, the coarsest as wide as the whole map. From
    there each place descends: an occupied cell holds a segment no farther than its farthest corner,
    which bounds the place's distance, and children that lie wholly beyond the least bound
    are dropped. A place far from everything so reaches a few cells of the finest grid instead of all
    segments. Points without (finite) coordinates come back with NULL, as do all if there is no segment.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    located = points.select(F.col(point_id), F.col(x).alias("px"), F.col(y).alias("py")).where(known("px") & known("py"))
    places = cut_lineage(located.select("px", "py").distinct())
    # equal segments are one, with the least of their attributes
    ends = ["x1", "y1", "x2", "y2"]
    shapes = edges.groupBy(*ends).agg(F.min(F.struct(*attrs)).alias("m")) if attrs else edges.select(*ends, F.struct(F.lit(0)).alias("m")).distinct()
    shapes = cut_lineage(shapes)
    cand = cut_lineage(nearest_cells(places, shapes, cell))
    lines = cut_lineage(along_segment(shapes, F.lit(float(cell))))
    # the distance to the segments of the nearest cell bounds the others: few are met, and only those within it are kept
    w = W.partitionBy("px", "py").orderBy("least", "cx", "cy")
    own = cand.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    to_line = lambda c: c.select("px", "py", "cx", "cy", *(["d"] if "d" in c.columns else [])).hint("shuffle_hash").join(lines, ["cx", "cy"])
    bound = to_line(own).groupBy("px", "py").agg(F.min(segment_distance("px", "py")).alias("d"))
    near = cand.join(cut_lineage(bound).hint("merge"), ["px", "py"]).where(F.col("least") <= F.col("d") * (1 + 1e-9) + 1e-5 * float(cell))
    near = to_line(near).withColumn("dist", segment_distance("px", "py")).where(F.col("dist") <= F.col("d"))
    near = near.select("px", "py", F.struct("dist", *[F.col(f"m.{a}").alias(a) for a in attrs]).alias("m"))
    best = near.groupBy("px", "py").agg(F.min("m").alias("m"))
    best = attach_units(located, best, ["px", "py"]).groupBy(point_id).agg(F.min("m").alias("m"))
    return points.select(point_id).distinct().join(best, point_id, "left").select(point_id, "m.dist", *[f"m.{a}" for a in attrs])


def nearest_cells(places: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(px, py, cx, cy, least): per place the cells of the finest grid that may hold its nearest segment, no
    nearer than `least`."""
    top = grid_levels(places, edges, cell, "px", "py") - 1
    cells = along_segment(edges.select("x1", "y1", "x2", "y2"), F.lit(float(cell))).select("cx", "cy").distinct()
    below = []  # per level above the finest: the occupied children of each occupied cell, 16 at most
    for _ in range(top):
        parent = [F.floor(F.col(c) / 4).alias(f"u{c}") for c in ("cx", "cy")]
        kids = cells.groupBy(*parent).agg(F.collect_list(F.struct("cx", "cy")).alias("kids"))
        below.append(cut_lineage(kids.withColumnsRenamed({"ucx": "cx", "ucy": "cy"})))
        cells = below[-1].select("cx", "cy")
    roots = [F.struct(F.lit(r.cx).alias("cx"), F.lit(r.cy).alias("cy")) for r in cells.collect()]  # the map is one cell wide: four at most
    if not roots:
        return places.select("*", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(0.0).alias("least")).where(F.lit(False))
    cand = places.withColumn("r", F.explode(F.array(*roots))).select("px", "py", F.lit(float("inf")).alias("bound"), F.lit(0.0).alias("least"), "r.*")
    w = W.partitionBy("px", "py")
    for level in range(top - 1, -1, -1):
        size = cell * 4.0**level
        kids = attach_units(cand, below[level], ["cx", "cy"], written=True).select("px", "py", "bound", F.explode("kids").alias("k")).select("px", "py", "bound", "k.*")
        low = {c: F.col(k) * size for c, k in (("px", "cx"), ("py", "cy"))}
        nearer = [F.greatest(low[c] - F.col(c), F.col(c) - (low[c] + size), F.lit(0.0)) for c in low]
        farther = [F.greatest(F.abs(F.col(c) - low[c]), F.abs(F.col(c) - (low[c] + size))) for c in low]
        length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
        # a hair of slack: along_segment may name a cell that the segment only touches from outside
        kids = kids.withColumns({"least": length(nearer) * (1 - 1e-9), "most": length(farther) * (1 + 1e-9) + 1e-5 * size})
        kids = kids.withColumn("bound", F.least("bound", F.min("most").over(w)))
        cand = kids.where("least <= bound").select("px", "py", "bound", "least", "cx", "cy")
    return cand.select("px", "py", "cx", "cy", "least")


def grid_levels(points: DataFrame, edges: DataFrame, cell: float, x: str = "x", y: str = "y") -> int:
    """Grids of cell*4^k needed until one cell is as wide as all points and edges together."""
    ends = lambda a, b: [F.min(F.least(a, b)), F.max(F.greatest(a, b))]
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    p = points.where(finite(x) & finite(y)).agg(*ends(F.col(x), F.col(x)), *ends(F.col(y), F.col(y))).first()
    e = edges.agg(*ends(F.col("x1"), F.col("x2")), *ends(F.col("y1"), F.col("y2"))).first()
    known = [v for v in (*p[:2], *e[:2]) if v is not None], [v for v in (*p[2:], *e[2:]) if v is not None]
    extent = max((max(v) - min(v) for v in known if v), default=0.0)
    levels = 1
    while cell * 4.0 ** (levels - 1) < extent:
        levels += 1
    return levels


def along_segment(segments: DataFrame, size: Column) -> DataFrame:
    """Add the cells (cx, cy) that each segment x1,y1 - x2,y2 passes: by columns of cells, in each
    the rows between the ends of the part inside. As many rows as cells, not as the box has."""
    d = segments.withColumn("__s", size).withColumn("cx", span(cell_of(F.least("x1", "x2"), F.col("__s")), cell_of(F.greatest("x1", "x2"), F.col("__s"))))
    dx = F.col("x2") - F.col("x1")
    at = lambda v: F.col("y1") + (F.col("y2") - F.col("y1")) * F.try_divide(v - F.col("x1"), dx)
    left = F.greatest(F.least("x1", "x2"), F.col("cx") * F.col("__s"))
    right = F.least(F.greatest("x1", "x2"), (F.col("cx") + 1) * F.col("__s"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    pad = F.col("__s") * 1e-6  # rounding may not lose a cell; one too many does no harm
    y0, y1 = (F.when(dx == 0, v).otherwise(F.greatest(low, F.least(high, f(at(left), at(right))))) for v, f in ((low, F.least), (high, F.greatest)))
    return d.withColumn("cy", span(cell_of(y0 - pad, F.col("__s")), cell_of(y1 + pad, F.col("__s")))).drop("__s")


def with_nearest_fallback(
    hits: DataFrame, points: DataFrame, edges: DataFrame, point_id: str, cell: float, rest: DataFrame | None = None
) -> DataFrame:
    """Polygon per point where there is one, else the polygon whose border is nearest. `rest` are the points
    without a hit, if already known."""
    found = hits.select(point_id, "geom_id").withColumn("by", F.lit("inside"))
    if rest is None:
        rest = points.join(hits.select(point_id).distinct(), point_id, "left_anti")
    near = nearest_segment(cut_lineage(rest), edges, point_id, ["geom_id"], cell)
    return found.unionByName(near.select(point_id, "geom_id", F.lit("nearest").alias("by")))


def label_near(segments: DataFrame, others: DataFrame, seg_id: str, tol: float, name: str) -> DataFrame:
    """1/0: does the midpoint of a (short) segment lie within `tol` of a segment of `others`?"""
    mids = segments.select(
        F.col(seg_id), ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py")
    )
    size = float(tol) * (1 + 1e-9)  # no two cells apart within tol
    cells = along_segment(others.select("x1", "y1", "x2", "y2").distinct(), F.lit(size))
    places = mids.select("px", "py").distinct().withColumn("cx", around(cell_of("px", size))).withColumn("cy", around(cell_of("py", size)))
    here, there = places.alias("p"), cells.hint("merge").alias("c")  # not broadcast: cells are many more than the table they come from
    same = (F.col("p.cx") == F.col("c.cx")) & (F.col("p.cy") == F.col("c.cy"))
    found = here.join(there, same & (segment_distance("px", "py") <= float(tol)), "left_semi").select("px", "py").distinct()
    near = mids.join(found.hint("merge"), ["px", "py"], "left_semi").select(seg_id).distinct().withColumn("__hit", F.lit(1))
    return segments.join(near.hint("merge"), seg_id, "left").withColumn(name, F.coalesce("__hit", F.lit(0))).drop("__hit")


def snap_edges(edges: DataFrame, step: float) -> DataFrame:
    """Vertices to a grid of `step`; segments that collapse or repeat inside a part are dropped."""
    snapped = edges
    for c in ("x1", "y1", "x2", "y2"):
        snapped = snapped.withColumn(c, F.round(F.col(c) / step) * step)
    return snapped.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).dropDuplicates(
        ["geom_id", "part", "x1", "y1", "x2", "y2"]
    )


def polygon_centroids(edges: DataFrame) -> DataFrame:
    """Signed-area centroid and area of each polygon from its edges, one aggregate."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return (
        edges.groupBy("geom_id")
        .agg(
            (F.sum(cross) / 2).alias("a"),
            F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"),
            F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"),
            F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))).alias("perimeter"),
        )
        .where(F.col("a") != 0)
        .select(
            "geom_id",
            (F.col("mx") / (6 * F.col("a"))).alias("x"),
            (F.col("my") / (6 * F.col("a"))).alias("y"),
            F.abs("a").alias("area"),
            "perimeter",
        )
    )


def band_totals(units: DataFrame, cands: DataFrame, factor: float = 4.0, area: str = "area") -> DataFrame:
    """(u_id, n, total): number and summed area of the candidates that `area_band_join` pairs with a unit.

    Equal areas count once on both sides. One running sum over the candidates' areas and both ends
    of the bands gives all totals, so the work grows with the rows and not with their pairs.
    """
    v = F.col(area).cast("double")
    u = cut_lineage(units.select(F.col("id").alias("u_id"), v.alias("a")).where("a > 0"))
    bands = u.select("a").distinct().withColumn("o", F.explode(F.array(F.lit(0), F.lit(2))))
    ends = bands.select(F.when(F.col("o") == 0, F.col("a") / factor).otherwise(F.col("a") * factor).alias("v"), "o", "a")
    held = cands.select(v.alias("v")).where("v > 0").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).withColumn("o", F.lit(1))
    line = cut_lineage(ends.unionByName(held, allowMissingColumns=True))
    run = scan(line, [], "v", ["o"], {"cn": ("sum", F.coalesce("n", F.lit(0)), "upto"), "cs": ("sum", F.coalesce("s", F.lit(0.0)), "upto")}).where("o <> 1")
    of = lambda c: F.max(F.when(F.col("o") == 2, F.col(c))) - F.max(F.when(F.col("o") == 0, F.col(c)))
    per = run.groupBy("a").agg(of("cn").alias("n"), of("cs").alias("total")).where("n > 0")
    return u.join(per.hint("merge"), "a").groupBy("u_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# ---- look-alike search -----------------------------------------------------------------


# Ranges that a band join cuts the values into, and candidates that meet the units of a range in one task.
BAND_RANGES, BAND_ROWS = 64, 100_000


def area_band_join(units: DataFrame, cands: DataFrame, factor: float = 4.0, area: str = "area") -> DataFrame:
    """Pairs whose areas differ by at most `factor` either way; columns prefixed u_ and c_.

    The candidates' quantiles cut the values into ranges of about equal size; a unit is copied
    only to the ranges that its band reaches. A range of more than BAND_ROWS candidates, such as
    that of one value which many share, is dealt to several tasks, each with a copy of the units.
    Rows without a positive area pair with nothing.
    """
    u = units.select(*[F.col(c).alias(f"u_{c}") for c in units.columns]).where(F.col(f"u_{area}") > 0)
    c = cands.select(*[F.col(c).alias(f"c_{c}") for c in cands.columns]).where(F.col(f"c_{area}") > 0)
    probs = [i / BAND_RANGES for i in range(1, BAND_RANGES)]
    cuts = c.agg(F.percentile_approx(f"c_{area}", probs)).first()[0]
    if not cuts:
        return u.join(c, F.lit(False))
    bounds = F.array(*[F.lit(float(v)) for v in sorted(set(cuts))])
    place = lambda v: F.size(F.filter(bounds, lambda b: b <= v))
    c = c.withColumn("__b", place(F.col(f"c_{area}")))
    sizes = {r["__b"]: -(-r["n"] // BAND_ROWS) for r in c.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    parts = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("__b"))
    c = c.withColumn("__p", F.pmod(F.monotonically_increasing_id(), parts))
    low, high = F.col(f"u_{area}") / factor, F.col(f"u_{area}") * factor
    reached = u.withColumn("__b", span(place(low), place(high))).withColumn("__p", parts).where("__p IS NOT NULL")
    reached = reached.withColumn("__p", span(F.lit(0).cast("long"), F.col("__p").cast("long") - 1))
    inside = (F.col(f"c_{area}") >= low) & (F.col(f"c_{area}") <= high)
    return reached.join(c, ["__b", "__p"]).where(inside).drop("__b", "__p")


def lookalike_candidates(
    units: DataFrame, cands: DataFrame, factor: float = 4.0, radius: float = 1e6, cell: float = 5e5, area: str = "area", within: float | None = None
) -> DataFrame:
    """Candidates of similar size whose centroid lies within radius + sqrt(area/pi) of the unit, and `within` if given.

    Both frames hold `id, x, y, area`. Candidates are bundled by cell and size; a unit is copied only to the cells that
    its circle meets, not to sizes, and passes over bundles beyond its circle or band. Pairs are made from a bundle's
    arrays behind the join, so what is shuffled grows with the rows.
    """
    near = lambda lo, hi, v: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    length = lambda v, w: F.sqrt(v * v + w * w)
    u = _reaching(units, radius, area, within, cell).where(F.col(f"u_{area}") > 0)
    u = u.withColumns({"__x0": F.col("cx") * cell, "__y0": F.col("cy") * cell, "__x1": (F.col("cx") + 1) * cell, "__y1": (F.col("cy") + 1) * cell})
    slack = F.col("u_reach") * (1 + 1e-9) + 1e-9 * (F.abs("u_x") + F.abs("u_y"))  # rounding may not lose a bundle; one too many does no harm
    u = u.where(length(near("__x0", "__x1", "u_x"), near("__y0", "__y1", "u_y")) <= slack).drop("__x0", "__y0", "__x1", "__y1")
    c = cands.select(*[F.col(c).alias(f"c_{c}") for c in cands.columns]).where(F.col(f"c_{area}") > 0)
    c = c.withColumns({"__b": F.floor(F.log2(f"c_{area}")).cast("int"), "cx": cell_of("c_x", cell), "cy": cell_of("c_y", cell)})
    held = bundled(c, ["cx", "cy"], ["__b"], "c_x", "c_y", float(cell) / STRIPS, {"__a0": F.min(f"c_{area}"), "__a1": F.max(f"c_{area}")})
    u, held, on = dealt(u, held, ["cx", "cy"])
    low, high = F.col(f"u_{area}") / factor, F.col(f"u_{area}") * factor
    beyond = (F.col("__a1") < low) | (F.col("__a0") > high) | (length(near("__x0", "__x1", "u_x"), near("__y0", "__y1", "u_y")) > slack)
    met = u.join(held.hint("shuffle_hash"), on).where(~F.coalesce(beyond, F.lit(False)))
    met = met.select(*[f"u_{c}" for c in units.columns], "u_reach", F.inline("__s"))
    d = length(F.col("u_x") - F.col("c_x"), F.col("u_y") - F.col("c_y"))  # products: `pow` takes most of the time of a pair
    inside = (F.col(f"c_{area}") >= low) & (F.col(f"c_{area}") <= high)
    return met.where(inside).withColumn("dist", d).where(F.col("dist") <= F.col("u_reach")).drop("u_reach")


def _reaching(units: DataFrame, radius: float, area: str, within: float | None, cell: float) -> DataFrame:
    """Units, columns prefixed u_, with `u_reach` and one row for each cell (cx, cy) of the square around their circle."""
    r = F.lit(float(radius)) + F.sqrt(F.col(f"u_{area}") / math.pi)
    if within is not None:
        r = F.least(r, F.lit(float(within)))
    return (
        units.select(*[F.col(c).alias(f"u_{c}") for c in units.columns])
        .withColumn("u_reach", r)
        .withColumn("cx", span(cell_of(F.col("u_x") - F.col("u_reach"), cell), cell_of(F.col("u_x") + F.col("u_reach"), cell)))
        .withColumn("cy", span(cell_of(F.col("u_y") - F.col("u_reach"), cell), cell_of(F.col("u_y") + F.col("u_reach"), cell)))
    )


def _few_lookalikes(units: DataFrame, cands: DataFrame, factor: float, radius: float, area: str, within: float) -> DataFrame:
    """`lookalike_candidates` within so small a circle that few are found: a plain join.

    The equi-key is (log2 area bucket, cell x, cell y); a candidate has exactly one such key, so every pair appears once. The units' copies are many
    more than the units, so neither side may be broadcast for the small table it comes from.
    """
    reach = int(math.ceil(math.log2(factor))) + 1
    u = _reaching(units, radius, area, within, within).withColumn("__b", around(F.floor(F.log2(f"u_{area}")).cast("int"), reach))
    c = (
        cands.select(*[F.col(c).alias(f"c_{c}") for c in cands.columns])
        .withColumn("__b", F.floor(F.log2(f"c_{area}")).cast("int"))
        .withColumn("cx", cell_of("c_x", within))
        .withColumn("cy", cell_of("c_y", within))
    )
    d = F.sqrt(F.pow(F.col("u_x") - F.col("c_x"), 2) + F.pow(F.col("u_y") - F.col("c_y"), 2))
    return (
        u.join(c.hint("shuffle_hash"), ["__b", "cx", "cy"])
        .where((F.col(f"c_{area}") >= F.col(f"u_{area}") / factor) & (F.col(f"c_{area}") <= F.col(f"u_{area}") * factor))
        .withColumn("dist", d)
        .where(F.col("dist") <= F.col("u_reach"))
        .drop("__b", "cx", "cy", "u_reach")
    )


def nearest_lookalikes(
    units: DataFrame, cands: DataFrame, first: Column, n: int, factor: float = 4.0, radius: float = 1e6, area: str = "area", digits: int = 6
) -> DataFrame:
    """Per unit the n best of `lookalike_candidates`: (u_id, c_id, same, dist), those with `first` before the rest,
    then by distance to `digits` places, then by id.

    The search widens: at a radius where a unit has n candidates with `first`, all others are
    farther, so it is done; the rest go on with twice the radius, up to the whole.
    """
    ends = [f(c) for c in ("x", "y") for f in (F.min, F.max)]
    box = cands.agg(F.count(F.lit(1)), *ends).first()
    size = max(box[2] - box[1], 0.0) * max(box[4] - box[3], 0.0) if box[1] is not None and box[3] is not None else 0.0
    units = cut_lineage(units)
    whole = float(radius) + math.sqrt((units.agg(F.max(area)).first()[0] or 0.0) / math.pi)
    at = max(math.sqrt(8.0 * n * size / (math.pi * max(box[0], 1))), whole / 1024)
    slack, found, left = 10.0**-digits, [], units
    while True:
        last = at >= whole
        near = lookalike_candidates(left, cands, factor, radius, at, area) if last else _few_lookalikes(left, cands, factor, radius, area, at)
        near = near.select("u_id", "c_id", first.alias("same"), F.round("dist", digits).alias("dist"))
        best = cut_lineage(top_rows(near, ["u_id"], [F.col("same").desc(), F.col("dist"), F.col("c_id")], n))
        if last:
            return reduce(lambda a, b: a.unionByName(b), [*found, best])
        full = best.where(F.col("same") & (F.col("dist") + slack <= at)).groupBy("u_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= n).select("u_id")
        full = cut_lineage(full)
        found.append(best.join(full.hint("merge"), "u_id", "left_semi"))
        left = cut_lineage(left.join(full.select(F.col("u_id").alias("id")).hint("merge"), "id", "left_anti"))
        at *= 2


# ---- neighbours within a radius --------------------------------------------------------

# Neighbouring locations up to which a location is simply compared with each of them.
PAIR_LIMIT = 512


def _numbered(points: DataFrame, keys: list[str], radius: Column) -> DataFrame:
    """Points with `rad` and `gid`, a number standing for (keys, rad) in the joins below."""
    d = points.withColumn("rad", radius)
    ks = [*keys, "rad"]
    groups = cut_lineage(d.select(*ks).distinct().withColumn("gid", F.monotonically_increasing_id()))
    return attach_units(d, groups, ks, written=True)


def _disc_sums(points: DataFrame, split: int, x: str, y: str) -> DataFrame:
    """Per distinct location: n and the sum of squared distances over the points within the radius.

    Equal locations are merged first. Where the 3x3 block of radius-sized cells around a
    location is thinly filled its locations are compared one by one; in crowded places
    whole cells are added up instead, and cells cut by a circle are divided. Both ways are exact. `points` carry gid and rad.
    """
    loc = cut_lineage(
        points.groupBy("gid", F.col(x).alias("px"), F.col(y).alias("py"))
        .agg(F.count(F.lit(1)).alias("m"), F.first("rad").alias("rad"))
        .withColumn("bx", cell_of("px", F.col("rad")))
        .withColumn("by", cell_of("py", F.col("rad")))
    )
    grid = ["gid", "bx", "by"]
    here = loc.groupBy(*grid).agg(F.count(F.lit(1)).alias("c"))
    crowded = None
    thin_loc = loc
    if (here.agg(F.max("c")).first()[0] or 0) * 9 > PAIR_LIMIT:
        block = (
            here.select("gid", around("bx").alias("bx"), "by", "c").select("gid", "bx", around("by").alias("by"), "c")
            .groupBy(*grid)
            .agg(F.sum("c").alias("around"))
        )
        placed = cut_lineage(loc.join(block, grid))
        thin_loc = placed.where(F.col("around") <= PAIR_LIMIT)
        crowded = placed.where(F.col("around") > PAIR_LIMIT).select("gid", "rad", "px", "py")
    probe = thin_loc.select("gid", "rad", "px", "py", around("bx").alias("bx"), "by").select(
        "gid", "rad", "px", "py", "bx", around("by").alias("by")
    )
    other = loc.select(*grid, F.col("px").alias("qx"), F.col("py").alias("qy"), "m")
    dd = F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2)
    thin = (
        probe.join(other, grid)
        .withColumn("dd", dd)
        .where(F.sqrt("dd") <= F.col("rad"))
        .groupBy("gid", "px", "py")
        .agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("dd")).alias("d2"))
    )
    if crowded is None:
        return thin
    return thin.unionByName(_crowded_sums(loc.select("gid", "rad", "px", "py", "m"), crowded, split))


# Locations of a cell up to which they are compared one by one, and subdivisions at most.
LEAF_LOCATIONS, DEPTH = 32, 20


def _cell_sums(loc: DataFrame, g: Column) -> DataFrame:
    """Per (gid, rad) and cell of size `g`: locations c, and points cn with the sums of their places
    from the cell's corner (sx, sy) and of its square (ss)."""
    x, y = F.col("px") - F.col("gx") * g, F.col("py") - F.col("gy") * g
    cells = loc.withColumn("gx", cell_of("px", g)).withColumn("gy", cell_of("py", g)).groupBy("gid", "rad", "gx", "gy")
    sums = {"cn": F.lit(1), "sx": x, "sy": y, "ss": x * x + y * y}
    return cells.agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.col("m") * v).alias(k) for k, v in sums.items()])


def _against_cell(g: Column) -> tuple[Column, Column]:
    """Does the disc around (px, py) hold the cell (gx, gy) wholly, or miss it?
    A hair of slack keeps borderline cells with those that are cut."""
    ox, oy = F.col("gx") * g, F.col("gy") * g
    far_x = F.greatest(F.abs(F.col("px") - ox), F.abs(F.col("px") - (ox + g)))
    far_y = F.greatest(F.abs(F.col("py") - oy), F.abs(F.col("py") - (oy + g)))
    near_x = F.greatest(ox - F.col("px"), F.col("px") - (ox + g), F.lit(0.0))
    near_y = F.greatest(oy - F.col("py"), F.col("py") - (oy + g), F.lit(0.0))
    rr = F.col("rad") * F.col("rad")
    return far_x * far_x + far_y * far_y <= rr * (1 - 1e-12), near_x * near_x + near_y * near_y > rr * (1 + 1e-12)


def _crowded_sums(loc: DataFrame, wanted: DataFrame, split: int) -> DataFrame:
    """Disc sums by cells of radius/split and their quarters' quarters.

    A cell wholly inside the disc gives its totals without touching its points, one outside
    nothing. A cell that the circle cuts is divided into 16, again and again, until it holds
    few locations, which are then compared one by one. A circle cuts about the square root of
    the cells, so many locations in one place cost far less than all their pairs.
    """
    key = ["gid", "rad"]
    g = F.col("rad") / split
    wanted = wanted.withColumn("hx", cell_of("px", g)).withColumn("hy", cell_of("py", g))
    cells = _cell_sums(loc, g)
    reach = split + 1
    offsets = [
        (i, j)
        for i in range(-reach, reach + 1)
        for j in range(-reach, reach + 1)
        if math.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) <= split
    ]
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    # cells holding data decide which neighbour cells exist: join cell to cell, not point to cell
    homes = wanted.select(*key, "hx", "hy").distinct().withColumn("o", F.explode(grid))
    homes = homes.select(*key, "hx", "hy", (F.col("hx") + F.col("o.i")).alias("gx"), (F.col("hy") + F.col("o.j")).alias("gy"))
    seen = wanted.join(homes.join(cells, [*key, "gx", "gy"]), [*key, "hx", "hy"]).drop("hx", "hy")
    parts = []
    for depth in range(DEPTH + 1):
        inside, outside = _against_cell(g)
        seen = cut_lineage(seen.where(~outside).withColumn("inside", inside))
        ax, ay = F.col("px") - F.col("gx") * g, F.col("py") - F.col("gy") * g
        d2 = F.col("ss") - 2 * ax * F.col("sx") - 2 * ay * F.col("sy") + F.col("cn") * (ax * ax + ay * ay)
        parts.append(seen.where("inside").select("gid", "px", "py", F.col("cn").alias("n"), d2.alias("d2")))
        cut = seen.where("NOT inside").select(*key, "px", "py", "gx", "gy", "c")
        many = cut.where(F.col("c") > LEAF_LOCATIONS)
        last = depth == DEPTH or many.isEmpty()
        few = (cut if last else cut.where(F.col("c") <= LEAF_LOCATIONS)).drop("c")
        at = [cell_of("px", g).alias("gx"), cell_of("py", g).alias("gy")]
        other = loc.select(*key, *at, F.col("px").alias("qx"), F.col("py").alias("qy"), "m")
        dd = F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2)
        one = few.join(other, [*key, "gx", "gy"]).withColumn("dd", dd).where(F.sqrt("dd") <= F.col("rad"))
        parts.append(one.select("gid", "px", "py", F.col("m").alias("n"), (F.col("m") * F.col("dd")).alias("d2")))
        if last:
            break
        g = g / 4  # a power of two, so that cells stay nested
        kids = _cell_sums(loc, g).withColumns({"ux": F.floor(F.col("gx") / 4), "uy": F.floor(F.col("gy") / 4)})
        kids = kids.groupBy(*key, "ux", "uy").agg(F.collect_list(F.struct("gx", "gy", "c", "cn", "sx", "sy", "ss")).alias("kids"))
        kids = cut_lineage(kids.withColumnsRenamed({"ux": "gx", "uy": "gy"}))
        seen = attach_units(many.drop("c"), kids, [*key, "gx", "gy"], written=True).select(*key, "px", "py", F.explode("kids").alias("k")).select(*key, "px", "py", "k.*")
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("gid", "px", "py").agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"))


# Rows up to which neighbours are joined on cells; more are dealt to tiles.
SWEEP_ROWS = 50_000


def _disc_rows(points: DataFrame, keys: list[str], radius: Column, radii: list[float] | None, squares: bool, split: int, x: str, y: str) -> DataFrame:
    """Points with n0, n1, ...: points of their group within each of `radii` (`radius` if None), and the sums d0, d1, ...
    of squared distances. Tiles serve all radii at once; small tables and groups too crowded for tiles are joined on cells.
    `points` are read several times and should be a written table."""
    d = _numbered(points, keys, radius)
    if d.count() <= SWEEP_ROWS:
        return _joined_sums(d, radii, squares, split, x, y)
    rest = {f"__c{i}": c for i, c in enumerate(c for c in points.columns if c not in (x, y))}
    inside = d.select("gid", "rad", F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), *[F.col(f"`{c}`").alias(k) for k, c in rest.items()])
    tiles = discs.tiled(inside, F.lit(max(radii)) if radii else F.col("rad"))
    crowded = cut_lineage(discs.crowded_groups(tiles))
    many = not crowded.isEmpty()
    swept = discs.with_disc_sums(tiles.join(F.broadcast(crowded), "gid", "left_anti") if many else tiles, radii, squares)
    back = [F.col("px").cast(points.schema[x].dataType).alias(x), F.col("py").cast(points.schema[y].dataType).alias(y)]
    swept = swept.select("*", *back) if (x, y) != ("px", "py") else swept
    swept = swept.withColumnsRenamed(rest).select(*points.columns, *[c for c in swept.columns if c[0] in "nd" and c[1:].isdigit()])
    if not many:
        return swept
    return swept.unionByName(_joined_sums(d.join(F.broadcast(crowded), "gid", "left_semi"), radii, squares, split, x, y).select(*swept.columns))


def _joined_sums(d: DataFrame, radii: list[float] | None, squares: bool, split: int, x: str, y: str) -> DataFrame:
    """`_disc_rows` by `_disc_sums`, each radius as a group of its own."""
    k = len(radii or [0])
    parts = {"n": "long"} | ({"d2": "double"} if squares else {})
    if k == 1:
        sums = _disc_sums(d.withColumn("rad", F.lit(radii[0])) if radii else d, split, x, y)
        sums = sums.select("gid", F.col("px").alias(x), F.col("py").alias(y), *[F.col(c).cast(t).alias(f"{c[0]}0") for c, t in parts.items()])
        return d.join(sums, ["gid", x, y])
    each = d.select("gid", x, y, F.posexplode(F.array(*[F.lit(r) for r in radii])).alias("__i", "rad")).withColumn("gid", F.col("gid") * k + F.col("__i"))
    at = lambda i, c: F.max(F.when(F.pmod("gid", F.lit(k)) == i, F.col(c).cast(parts[c]))).alias(f"{c[0]}{i}")
    sums = _disc_sums(each, split, x, y).groupBy(F.expr(f"gid div {k}").alias("__g"), F.col("px").alias(x), F.col("py").alias(y))
    sums = sums.agg(*[at(i, c) for i in range(k) for c in parts]).withColumnRenamed("__g", "gid")
    return d.join(sums, ["gid", x, y])


def neighbours_within(
    points: DataFrame, keys: list[str], radius: float | Column, name: str = "n_within", split: int = 3, x: str = "x", y: str = "y"
) -> DataFrame:
    """Number of points of the same group within `radius`, the point itself included."""
    d = _disc_rows(cut_lineage(points), keys, radius if isinstance(radius, Column) else F.lit(float(radius)), None, False, split, x, y)
    return d.select(*points.columns, F.col("n0").alias(name))


def kernel_density(
    points: DataFrame,
    keys: list[str],
    radius: float | Column,
    kernel: str = "gaussian",
    name: str = "dens",
    split: int = 3,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Kernel density at each point from the points of its group.

    Epanechnikov follows from the disc sums alone. The Gaussian is summed up to 9 bandwidths; what
    lies beyond weighs below 3e-18 of the point itself per neighbour, under the rounding of a double.
    Thin places are summed over pairs of distinct locations, crowded ones through `gauss`.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    if kernel == "epanechnikov":
        dens = 0.75 * (F.col("n0") - F.col("d0") / (r * r)) / (math.pi * r * r)
        return _disc_rows(cut_lineage(points), keys, r, None, True, split, x, y).select(*points.columns, dens.alias(name))
    points = cut_lineage(points)
    rr = F.col("rad") * F.col("rad")
    d = _numbered(points, keys, r)
    dens = lambda rows: rows.select(*points.columns, (F.col("k") / (2 * math.pi * rr)).alias(name))
    if d.count() <= SWEEP_ROWS:
        return dens(_gaussian_pairs(d, None, x, y))
    rest = {f"__c{i}": c for i, c in enumerate(points.columns)}
    inside = d.select("gid", "rad", F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), *[F.col(f"`{c}`").alias(k) for k, c in rest.items()])
    tiles = cut_lineage(gauss.boxed(inside))
    around = cut_lineage(gauss.tiles_around(tiles))
    crowded, thin = (around.where(c).drop("around") for c in (F.col("around") > GAUSS_PAIRS, F.col("around") <= GAUSS_PAIRS))
    summed = gauss.with_gaussian_sums(tiles, crowded)
    few = _gaussian_pairs(tiles.drop("tx", "ty", "bx", "by"), tiles.join(thin, ["gid", "tx", "ty"], "left_semi"), "px", "py")
    both = summed.unionByName(few.select(*summed.columns))
    return dens(both.drop("px", "py").withColumnsRenamed(rest))


# Rows in and around a tile of 9 bandwidths up to which the Gaussian is summed over pairs.
GAUSS_PAIRS = 2_000


def _gaussian_pairs(d: DataFrame, wanted: DataFrame | None, x: str, y: str) -> DataFrame:
    """Rows (of `wanted`, all if None) with k, the Gaussian sum over the pairs of distinct locations of `d`."""
    merged = lambda rows: rows.groupBy("gid", F.col(x).alias("px"), F.col(y).alias("py")).agg(F.count(F.lit(1)).alias("m"), F.first("rad").alias("rad"))
    loc = cut_lineage(merged(d))
    reach = F.col("rad") * 9
    cell = [cell_of("px", reach).alias("gx"), cell_of("py", reach).alias("gy")]
    probe = (loc if wanted is None else merged(wanted)).select("gid", "rad", "px", "py", *cell)
    probe = probe.withColumn("gx", around("gx")).withColumn("gy", around("gy"))
    other = loc.select("gid", F.col("px").alias("qx"), F.col("py").alias("qy"), "m", *cell)
    u2 = (F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2)) / (F.col("rad") * F.col("rad"))
    sums = probe.join(other, ["gid", "gx", "gy"]).groupBy("gid", F.col("px").alias(x), F.col("py").alias(y)).agg(
        F.sum(F.col("m") * F.exp(u2 * -0.5)).alias("k")
    )
    return (d if wanted is None else wanted).join(sums, ["gid", x, y])


def decluster_weights(
    points: DataFrame,
    keys: list[str],
    radius: float | Column,
    kernel: str | None = None,
    cap: float = 0.99,
    name: str = "w",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Inverse-density weights: capped at the group's `cap` quantile, mean one.

    Without `kernel` the density is the neighbour count. A radius of zero and groups of
    fewer than three points give weight 1. The floor on the density is a fixed value, 1e-12.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    flat = points.where(r <= 0)
    work = points.where(r > 0)
    if kernel is None:
        d = neighbours_within(work, keys, r, "__d", x=x, y=y)
        raw = F.lit(1.0) / F.col("__d")
    else:
        d = kernel_density(work, keys, r, kernel, "__d", x=x, y=y)
        raw = F.lit(1.0) / F.greatest(F.col("__d"), F.lit(1e-12))
    # stored once: the density joins feed the cap, the mean and the result
    d = cut_lineage(d.withColumn("__w", raw).drop("__d"))
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    qs = exact_quantiles(d, keys, "__w", [cap], name="__q")
    caps = attach_group(qs.withColumn("__cap", F.col("__q")[0]).drop("__q"), sizes, keys)
    d = attach_units(d, caps, keys).withColumn("__w", F.least("__w", "__cap"))
    means = d.groupBy(*keys).agg(F.avg("__w").alias("__m"))
    d = attach_units(d, means, keys)
    d = d.withColumn(name, F.when(F.col("__n") < 3, 1.0).otherwise(F.col("__w") / F.col("__m")))
    return d.drop("__w", "__cap", "__n", "__m").unionByName(flat.withColumn(name, F.lit(1.0)))


def decluster_by_radius(
    points: DataFrame, keys: list[str], radii: list[float], cap: float = 0.99, name: str = "w", radius: str = "dclust", x: str = "x", y: str = "y"
) -> DataFrame:
    """Points once for each radius, with the weights that `decluster_weights` gives at that radius.

    The counts of all radii come from one pass and are stored side by side; rows are repeated only
    when they are read. Cap and mean follow from how often each count occurs.
    """
    points = cut_lineage(points)
    some = [float(r) for r in radii if r > 0]
    d = cut_lineage(_disc_rows(points, keys, F.lit(max(some)), some, False, 3, x, y)) if some else points
    at = {r: F.col(f"n{i}") for i, r in enumerate(some)}
    each = lambda rs: F.inline(F.array(*[F.struct(F.lit(float(r)).alias(radius), at.get(r, F.lit(1)).cast("long").alias("__d")) for r in rs]))
    rows = d.select(*points.columns, each([float(r) for r in radii]))
    if some and len(some) < len(radii):  # a radius of zero needs no place
        placed = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
        rows = rows.unionByName(points.where(~F.coalesce(placed, F.lit(False))).select("*", each([float(r) for r in radii if r <= 0])))
    ks = [*keys, radius]
    often = cut_lineage(rows.groupBy(*ks, "__d").agg(F.count(F.lit(1)).alias("__c")))
    w = F.lit(1.0) / F.col("__d")
    caps = often.groupBy(*ks).agg(F.sum("__c").alias("__n"), F.percentile(w, F.lit(float(cap)), F.col("__c")).alias("__cap"))
    capped = F.least(w, F.col("__cap"))
    per = attach_group(often, caps, ks).groupBy(*ks, "__n", "__cap").agg((F.sum(F.col("__c") * capped) / F.sum("__c")).alias("__m"))
    weight = F.when(F.col("__n") < 3, 1.0).otherwise(capped / F.col("__m"))
    return attach_units(rows, per, ks).select(*points.columns, radius, weight.alias(name))
