"""Area algebra on grid cells.

An area is the set of equal-area cells (cx, cy) whose centre it covers. Overlay, dissolve,
difference, buffer and border length are then hash joins and distincts. Areas are exact up
to the cells cut by the outline.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.operators.prefix import null_safe_join
from panelweave.operators.tables import rows_at_max
from panelweave.session import cut_lineage

XY = ["cx", "cy"]


def fill_polygons(edges: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Cells whose centre lies inside the polygon, by scan lines (even-odd rule).

    Each edge yields its crossing with every row of centres it spans; the sorted crossings
    of one row pair up into runs of cells. A row group is bounded by the edges of one polygon.
    """
    keys = keys or ["geom_id"]
    half = size / 2
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.ceil((lo - half) / size).cast("long")
    last = (F.ceil((hi - half) / size) - 1).cast("long")
    rows = (
        edges.withColumn("__a", first)
        .withColumn("__z", last)
        .where(F.col("__a") <= F.col("__z"))
        .withColumn("cy", F.explode(F.sequence("__a", "__z")))
    )
    yc = F.col("cy") * size + half
    xs = F.col("x1") + (F.col("x2") - F.col("x1")) * (yc - F.col("y1")) / (F.col("y2") - F.col("y1"))
    runs = rows.groupBy(*keys, "cy").agg(F.sort_array(F.collect_list(xs)).alias("xs"))
    pairs = runs.where(F.size("xs") >= 2).withColumn("k", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1)))
    a = F.ceil((F.col("xs")[F.col("k") * 2] - half) / size).cast("long")
    z = (F.ceil((F.col("xs")[F.col("k") * 2 + 1] - half) / size) - 1).cast("long")
    return (
        pairs.withColumn("__a", a)
        .withColumn("__z", z)
        .where(F.col("__a") <= F.col("__z"))
        .select(*keys, F.explode(F.sequence("__a", "__z")).alias("cx"), "cy")  # runs of a row do not overlap
    )


def trace_lines(edges: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Cells met by segments, sampled at a quarter of a cell."""
    keys = keys or ["geom_id"]
    n = F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / (size / 4)).cast("int")
    d = edges.withColumn("__n", F.greatest(n, F.lit(1))).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    t = F.col("__k") / F.col("__n")
    return d.select(
        *keys,
        F.floor((F.col("x1") + t * (F.col("x2") - F.col("x1"))) / size).cast("long").alias("cx"),
        F.floor((F.col("y1") + t * (F.col("y2") - F.col("y1"))) / size).cast("long").alias("cy"),
    ).distinct()


def cells_of_points(points: DataFrame, size: float, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return points.select(
        *keys, F.floor(F.col(x) / size).cast("long").alias("cx"), F.floor(F.col(y) / size).cast("long").alias("cy")
    ).distinct()


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in both, attributes of both."""
    return a.join(b, XY)


def overlay_area(a: DataFrame, b: DataFrame, keys: list[str], cell_area: float, name: str = "area") -> DataFrame:
    return overlay(a, b).groupBy(*keys).agg((F.count(F.lit(1)) * float(cell_area)).alias(name))


def main_owner(a: DataFrame, b: DataFrame, key: str, owner: str, cell_area: float) -> DataFrame:
    """The owner with the largest overlap per key, ties kept."""
    return rows_at_max(overlay_area(a, b, [key, owner], cell_area, "overlap_area"), [key], "overlap_area")


def dissolve(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, *XY).distinct()


def difference(a: DataFrame, b: DataFrame, keys: list[str] = ()) -> DataFrame:
    return a.join(b.select(*keys, *XY).distinct(), [*keys, *XY], "left_anti")


def dilate(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Buffer by k cells (a disc in cell units), by runs of a row: each run is widened in the rows
    around it and the runs of a row are merged, so that cells are made once."""
    by = [*keys, "cy"]
    w = W.partitionBy(*by).orderBy("cx")
    line = cells.select(*keys, *XY).distinct().withColumn("__i", F.col("cx") - F.row_number().over(w))
    runs = line.groupBy(*by, "__i").agg(F.min("cx").alias("__a"), F.max("cx").alias("__z"))
    off = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(math.isqrt(k * k - j * j)).alias("w")) for j in range(-k, k + 1)])
    wide = runs.withColumn("o", F.explode(off)).select(
        *keys, (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("__a") - F.col("o.w")).alias("__a"), (F.col("__z") + F.col("o.w")).alias("__z")
    )
    over = W.partitionBy(*by).orderBy("__a", "__z").rowsBetween(W.unboundedPreceding, -1)
    start = F.greatest(F.col("__a"), F.coalesce(F.max("__z").over(over) + 1, F.col("__a")))
    left = wide.withColumn("__from", start).where(F.col("__from") <= F.col("__z"))  # what no run before has
    return left.select(*keys, F.explode(F.sequence("__from", "__z")).alias("cx"), "cy")


def areas(cells: DataFrame, keys: list[str], cell_area: float, name: str = "area") -> DataFrame:
    return cells.select(*keys, *XY).distinct().groupBy(*keys).agg((F.count(F.lit(1)) * float(cell_area)).alias(name))


def meets(units: DataFrame, unit_cells: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Boolean column: does the unit share a cell with `other`?"""
    hit = unit_cells.join(other.select(*XY).distinct(), XY, "left_semi").select(key).distinct().withColumn("__h", F.lit(True))
    return units.join(hit, key, "left").withColumn(name, F.coalesce("__h", F.lit(False))).drop("__h")


def without_contact(units: DataFrame, unit_cells: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Units sharing no cell with `other`."""
    hit = unit_cells.join(other.select(*XY).distinct(), XY, "left_semi").select(key).distinct()
    return units.join(hit, key, "left_anti")


def border_contacts(cells: DataFrame, group: str, member: str) -> DataFrame:
    """Cell sides shared by two members of a group, each side once, members ordered.

    Only neighbouring cells meet, so the rows grow with border length, not with the square
    of the group.
    """
    c = cells.select(group, member, *XY).distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (0, 1))])
    right = (
        c.withColumn("o", F.explode(steps))
        .select(
            group,
            F.col(member).alias("__m2"),
            F.col("cx").alias("cx2"),
            F.col("cy").alias("cy2"),
            (F.col("cx") - F.col("o.i")).alias("cx"),
            (F.col("cy") - F.col("o.j")).alias("cy"),
        )
    )
    j = c.join(right, [group, *XY]).where(F.col(member) != F.col("__m2"))
    return j.select(
        group,
        F.least(member, "__m2").alias(f"{member}_1"),
        F.greatest(member, "__m2").alias(f"{member}_2"),
        *XY,
        "cx2",
        "cy2",
    )


def border_pairs(cells: DataFrame, group: str, member: str, size: float) -> DataFrame:
    """Member pairs with a shared border and its length (in cell sides times size)."""
    return (
        border_contacts(cells, group, member)
        .groupBy(group, f"{member}_1", f"{member}_2")
        .agg((F.count(F.lit(1)) * float(size)).alias("border_length"))
    )


def border_meets(contacts: DataFrame, rivers: DataFrame, keys: list[str], k: int, name: str = "has_river_border") -> DataFrame:
    """Does the shared border, widened by k cells, meet a river cell?"""
    both = contacts.select(*keys, *XY).unionByName(
        contacts.select(*keys, F.col("cx2").alias("cx"), F.col("cy2").alias("cy"))
    )
    pairs = contacts.select(*keys).distinct()
    hit = dilate(both, keys, k).join(rivers.select(*XY).distinct(), XY, "left_semi").select(*keys).distinct()
    return null_safe_join(pairs, hit.withColumn("__h", F.lit(True)), keys, "left").withColumn(
        name, F.coalesce("__h", F.lit(False))
    ).drop("__h")


def overlap_share(cells: DataFrame, key: str, mask: Column, feasible: Column | None = None) -> DataFrame:
    """Share of the masked cells lying in two or more areas, and of those also feasible.

    `mask`/`feasible` are expressions on cell attributes present in `cells`.
    """
    f = feasible if feasible is not None else F.lit(True)
    per = cells.groupBy(*XY).agg(
        F.countDistinct(key).alias("n"), F.max(mask.cast("int")).alias("m"), F.max(f.cast("int")).alias("f")
    )
    many = (F.col("n") >= 2).cast("int")
    tot = F.sum("m")
    return per.agg(
        tot.alias("cells"),
        F.try_divide(F.sum(F.col("m") * many), tot).alias("overlap_share"),
        F.try_divide(F.sum(F.col("m") * many * F.col("f")), tot).alias("feasible_overlap_share"),
    )


def _corners(cells: DataFrame, key: str) -> DataFrame:
    """Cells with `left` and `down`: does the area hold the cell to the left, the one below?"""
    w = lambda along, across: W.partitionBy(key, across).orderBy(along)
    held = lambda along, across: F.coalesce(F.lag(along).over(w(along, across)) == F.col(along) - 1, F.lit(False))
    return cells.select(F.col(key), *XY).where(F.col(key).isNotNull()).distinct().withColumn("left", held("cx", "cy")).withColumn("down", held("cy", "cx"))


def overlap_edges(cells: DataFrame, key: str) -> DataFrame:
    """Pairs of areas sharing at least one cell (a < b).

    What two areas share has a cell with none to the left and none below. There one of the two
    areas has no cell to the left and one none below, so corner cells meet all cells, left borders
    meet lower borders, and inner cells do not meet each other. Two rectangles meet in one such
    cell; only pairs with another shape may come twice.
    """
    c = cut_lineage(_corners(cells, key))
    full = (F.max("cx") - F.min("cx") + 1) * (F.max("cy") - F.min("cy") + 1)
    odd = cut_lineage(c.groupBy(key).agg((F.count(F.lit(1)) < full).alias("odd")).where("odd").select(key))
    shaped = not odd.isEmpty()
    if shaped:
        c = cut_lineage(c.join(odd.withColumn("odd", F.lit(True)), key, "left").withColumn("odd", F.coalesce("odd", F.lit(False))))
    else:
        c = c.withColumn("odd", F.lit(False))
    side = lambda d, n: d.select(F.col(key).alias(n), *XY, F.col("odd").alias(f"odd_{n}"), (~F.col("left") & ~F.col("down")).alias(f"corner_{n}"))
    # the sizes of cell tables are not those of the tables they come from: no broadcast
    met = side(c, "b").join(side(c.where("NOT left AND NOT down"), "a").hint("shuffle_hash"), XY).where("a <> b AND (NOT corner_b OR a < b)")
    met = met.select("a", "b", "odd_a", "odd_b").unionByName(
        side(c.where("NOT left AND down"), "a").join(side(c.where("left AND NOT down"), "b").hint("shuffle_hash"), XY).where("a <> b").select("a", "b", "odd_a", "odd_b")
    )
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    if not shaped:
        return met.select(*pair)
    return met.where("NOT odd_a AND NOT odd_b").select(*pair).unionByName(met.where("odd_a OR odd_b").select(*pair).distinct())
