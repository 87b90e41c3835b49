"""Gaussian kernel sums in time that grows with the rows: the fast Gauss transform by interpolation.

A square box one bandwidth wide stands for its rows by weights at ORDER x ORDER Chebyshev nodes. The
Gaussian between two boxes is a small matrix that depends on their offset only, so nodes meet nodes,
and a row reads its sum from the nodes of its box. On such a box the interpolation error of the kernel
is below 1e-15 per row summed; boxes more than REACH apart weigh below 3e-18 a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH, ORDER = 9, 16
# Rows of a tile (REACH x REACH boxes) that one task takes at a time.
PART_ROWS = 100_000
_KEY = ["gid", "tx", "ty"]


def _nodes() -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(ORDER) + 1) / (2 * ORDER))


def _weights(at: np.ndarray, box: np.ndarray, side: float) -> np.ndarray:
    """Interpolation weights (a row per place) of the nodes of the places' boxes, along one axis."""
    k = np.arange(ORDER)[:, None]
    c = 2 / ORDER * np.where(k == 0, 0.5, 1.0) * np.cos(k * np.pi * (2 * np.arange(ORDER) + 1) / (2 * ORDER))
    return np.polynomial.chebyshev.chebvander(2 * (at / side - box) - 1, ORDER - 1) @ c


def _along() -> np.ndarray:
    """Kernel between the nodes of REACH boxes and those of the 3 REACH boxes around them, along one axis."""
    own, other = np.arange(REACH), np.arange(-REACH, 2 * REACH)
    off = (own[:, None] - other)[:, None, :, None] + (_nodes()[:, None, None] - _nodes()) / 2
    near = np.abs(own[:, None] - other) <= REACH
    return (np.exp(-0.5 * off**2) * near[:, None, :, None]).reshape(REACH * ORDER, 3 * REACH * ORDER)


def _by_box(block: pa.Table):
    """Places of a block sorted by box: boxes, their bounds, the order, and the weights along both axes."""
    get = lambda c: block[c].to_numpy()
    bx, by, side = get("bx"), get("by"), block["rad"][0].as_py()
    order = np.lexsort((by, bx))
    boxes, first = np.unique(np.column_stack([bx, by])[order], axis=0, return_index=True)
    return boxes, [*first, len(order)], order, _weights(get("px")[order], bx[order], side), _weights(get("py")[order], by[order], side)


def _table(block: pa.Table, boxes: np.ndarray, values: np.ndarray) -> pa.Table:
    keys = {k: [block[k][0].as_py()] * len(boxes) for k in _KEY}
    return pa.table(keys | {"bx": boxes[:, 0], "by": boxes[:, 1], "v": pa.array(list(values.reshape(len(boxes), ORDER * ORDER)), pa.list_(pa.float64()))})


def _gathered(block: pa.Table) -> pa.Table:
    boxes, at, _, wx, wy = _by_box(block)
    return _table(block, boxes, np.array([wx[a:b].T @ wy[a:b] for a, b in zip(at, at[1:])]))


def _spread(block: pa.Table) -> pa.Table:
    """Sums at the nodes of the tile's own boxes from the weights in and around it."""
    get = lambda c: block[c].to_numpy()
    ox, oy = block["tx"][0].as_py() * REACH, block["ty"][0].as_py() * REACH
    bx, by = get("bx") - ox, get("by") - oy
    v = block["v"].combine_chunks().values.to_numpy().reshape(-1, ORDER, ORDER)
    grid = np.zeros((3 * REACH, 3 * REACH, ORDER, ORDER))
    np.add.at(grid, (bx + REACH, by + REACH), v)
    flat = grid.transpose(0, 2, 1, 3).reshape(3 * REACH * ORDER, -1)
    k = _along()
    sums = (k @ flat @ k.T).reshape(REACH, ORDER, REACH, ORDER).transpose(0, 2, 1, 3)
    own = (np.minimum(bx, by) >= 0) & (np.maximum(bx, by) < REACH)
    boxes = np.unique(np.column_stack([bx, by])[own], axis=0)
    return _table(block, boxes + [ox, oy], sums[boxes[:, 0], boxes[:, 1]])


def with_gaussian_sums(tiles: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the tiles `asked` (gid, tx, ty) with k, the sum of exp(-u^2/2) over the rows of their group, u in bandwidths.

    `tiles` are written rows with gid, rad (the bandwidth), px, py, and from `boxed` their box and tile.
    """
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = tiles.groupBy(*_KEY).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    rows = tiles.join(parts, _KEY).withColumn("part", F.pmod(F.xxhash64("px", "py"), F.col("parts")).cast("int")).drop("parts")
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    kind = "gid bigint, tx bigint, ty bigint, bx bigint, by bigint, v array<double>"
    gathered = rows.select(*_KEY, "part", "rad", "px", "py", "bx", "by").repartition(n, *_KEY, "part").groupBy(*_KEY, "part").applyInArrow(_gathered, kind)
    around = gathered.select("gid", near("tx"), "ty", "bx", "by", "v").select("gid", "tx", near("ty"), "bx", "by", "v").join(asked, _KEY, "left_semi")
    spread = around.repartition(n, *_KEY).groupBy(*_KEY).applyInArrow(_spread, kind)
    spread = spread.join(parts, _KEY).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    mine = rows.join(asked, _KEY, "left_semi")
    keep = [c for c in tiles.columns if c not in (*_KEY, "bx", "by")]
    keep = ["gid", *[c for c in keep if c != "gid"]]

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(keep).append_column("k", pa.array([], pa.float64()))
        boxes, at, order, wx, wy = _by_box(left)
        v = right["v"].combine_chunks().values.to_numpy().reshape(-1, ORDER, ORDER)
        field = {b: f for b, f in zip(zip(right["bx"].to_pylist(), right["by"].to_pylist()), v)}
        k = np.empty(len(order))
        for (bx, by), a, b in zip(boxes.tolist(), at, at[1:]):
            k[order[a:b]] = ((wx[a:b] @ field[bx, by]) * wy[a:b]).sum(axis=1)
        return left.select(keep).append_column("k", pa.array(k))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keep).schema) + ", k double"
    return mine.groupBy(*_KEY, "part").cogroup(spread.groupBy(*_KEY, "part")).applyInArrow(read, kinds)


def boxed(d: DataFrame) -> DataFrame:
    """Rows with finite px, py and their box (bx, by) and tile (tx, ty)."""
    d = d.where((F.abs("px") < float("inf")) & (F.abs("py") < float("inf")))
    box, tile = (lambda c: F.floor(F.col(c) / F.col("rad")).cast("long")), (lambda c: F.floor(F.col(c) / REACH).cast("long"))
    return d.withColumns({"bx": box("px"), "by": box("py")}).withColumns({"tx": tile("bx"), "ty": tile("by")})


def tiles_around(tiles: DataFrame) -> DataFrame:
    """Per tile with rows: the rows in and around it."""
    here = tiles.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c"))
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    block = here.select("gid", near("tx"), "ty", "c").select("gid", "tx", near("ty"), "c").groupBy(*_KEY).agg(F.sum("c").alias("around"))
    return here.select(*_KEY).join(block, _KEY)
