"""Sums over discs around many rows at once: rows are dealt to tiles, numpy sums each tile in its task.

Every row goes to its tile and, as a neighbour, to the tiles within reach; so rows are shuffled
once whatever the number of radii, and come back with their sums without a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.prefix import attach_units

# Rows a tile should hold if they lay evenly, and rows in and around a tile up to which a task takes it.
TILE_ROWS, BLOCK_ROWS = 20_000, 500_000
# Pairs that are compared one by one at a time.
CHUNK = 1_000_000


def tiled(d: DataFrame, reach: Column) -> DataFrame:
    """Rows with finite coordinates px, py, their group's tile side and reach, and their tile (tx, ty).

    A tile is at least two reaches wide, so that a row has neighbours in four tiles at most.
    """
    d = d.where((F.abs("px") < float("inf")) & (F.abs("py") < float("inf")))
    wide = lambda c: F.max(c) - F.min(c)
    per = d.groupBy("gid").agg(F.count(F.lit(1)).alias("c"), wide("px").alias("w"), wide("py").alias("h"), F.max(reach).alias("reach"))
    share = F.lit(float(TILE_ROWS)) / F.col("c")
    side = F.greatest(F.col("reach") * 2, F.sqrt(F.col("w") * F.col("h") * share), F.greatest("w", "h") * share)
    d = attach_units(d, per.select("gid", "reach", side.alias("side")), ["gid"])
    at = lambda c: F.floor(F.col(c) / F.col("side")).cast("long")
    return d.withColumns({"tx": at("px"), "ty": at("py")})


def crowded_groups(tiles: DataFrame) -> DataFrame:
    """Groups (gid) with a tile that has more than BLOCK_ROWS rows in and around it."""
    here = tiles.groupBy("gid", "tx", "ty").agg(F.count(F.lit(1)).alias("c"))
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    block = here.select("gid", near("tx"), "ty", "c").select("gid", "tx", near("ty"), "c").groupBy("gid", "tx", "ty").agg(F.sum("c").alias("c"))
    return block.where(F.col("c") > BLOCK_ROWS).select("gid").distinct()


def with_disc_sums(tiles: DataFrame, radii: list[float] | None, squares: bool) -> DataFrame:
    """The rows with n0, n1, ... rows of their group within each radius (`rad` where None is given), themselves
    included, and with `squares` the sums d0, d1, ... of their squared distances."""
    names = [f"{c}{i}" for i in range(len(radii or [0])) for c in ("n", "d")[: 1 + squares]]
    own = [c for c in tiles.columns if c not in ("reach", "side", "tx", "ty")]
    slack = F.col("reach") * (1 + 1e-9) + (F.abs("px") + F.abs("py")) * 1e-14
    reached = lambda c, t: F.explode(F.sequence(F.floor((F.col(c) - slack) / F.col("side")), F.floor((F.col(c) + slack) / F.col("side")))).alias(t)
    d = tiles.withColumnsRenamed({"tx": "hx", "ty": "hy"}).select("*", reached("px", "tx")).select("*", reached("py", "ty"))
    d = d.withColumn("__own", (F.col("tx") == F.col("hx")) & (F.col("ty") == F.col("hy"))).select(*own, "tx", "ty", "__own")

    def sums(block: pa.Table) -> pa.Table:
        get = lambda c: block[c].to_numpy()
        px, py, mine = get("px"), get("py"), get("__own").astype(bool)
        places, at = np.unique(np.column_stack([px, py]), axis=0, return_inverse=True)
        at = at.ravel()
        asked = np.zeros(len(places), bool)
        asked[at[mine]] = True
        rs = radii or [block["rad"][0].as_py()]
        n, d2 = disc_sums(places[:, 0], places[:, 1], np.bincount(at), asked, rs, squares)
        out = block.filter(pa.array(mine)).select(own)
        for c in names:
            out = out.append_column(c, pa.array((n if c[0] == "n" else d2)[int(c[1:]), at[mine]]))
        return out

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*own).schema] + [f"{c} {'bigint' if c[0] == 'n' else 'double'}" for c in names])
    # a number of partitions given by hand: few bytes of rows are much work, so tasks are not merged by size
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gid", "tx", "ty")
    return d.groupBy("gid", "tx", "ty").applyInArrow(sums, kinds)


def disc_sums(px: np.ndarray, py: np.ndarray, m: np.ndarray, asked: np.ndarray, radii: list[float], squares: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per radius and place (where `asked`): copies `m` within the radius, and with `squares` the sum of their squared distances.

    Places are cut along x into strips of equal number, each sorted along y. A circle takes from a
    strip a run whose ends lie between its chords at the strip's two sides: what is within both
    chords is taken as a whole from running sums, the few places between them are compared.
    """
    n, d2 = np.zeros((len(radii), len(px)), np.int64), np.zeros((len(radii), len(px)))
    by_x = np.argsort(px, kind="stable")  # px, py, m in this order from here on
    t = by_x[asked[by_x]]
    tx, ty = px[t], py[t]
    per = int(3 * np.sqrt(len(px))) + 1
    tiny = 1e-14 * max(np.abs(px).max(), np.abs(py).max())
    for at in range(0, len(px), per):
        s = by_x[at : at + per]
        a, b = px[s[0]], px[s[-1]]
        s = s[np.argsort(py[s], kind="stable")]
        qx, qy, qm = px[s], py[s], m[s]
        cx, cy = (a + b) / 2, (qy[0] + qy[-1]) / 2
        run = lambda v: np.concatenate([[0], np.cumsum(v)])
        count = run(qm)
        if squares:
            u, v = qx - cx, qy - cy
            su, sv, ss = run(qm * u), run(qm * v), run(qm * (u * u + v * v))
        for i, r in enumerate(radii):
            hair = r * 1e-9 + tiny
            lo, hi = np.searchsorted(tx, a - r - hair), np.searchsorted(tx, b + r + hair, "right")
            if lo == hi:
                continue
            x, y = tx[lo:hi], ty[lo:hi]
            near, far = np.maximum(np.maximum(a - x, x - b), 0), np.maximum(np.abs(x - a), np.abs(x - b))
            chord = lambda h, d: (h - d) * (h + d)
            outer = np.sqrt(np.maximum(chord(r + hair, near), 0)) + hair
            inner = np.sqrt(np.maximum(chord(r - hair, far), 0)) - hair
            o0, o1 = np.searchsorted(qy, y - outer), np.searchsorted(qy, y + outer, "right")
            i0, i1 = np.searchsorted(qy, y - inner), np.searchsorted(qy, y + inner, "right")
            none = (inner < 0) | (far >= r - hair)
            i0[none] = i1[none] = o0[none]
            got = count[i1] - count[i0]
            if squares:
                X, Y = x - cx, y - cy
                whole = ss[i1] - ss[i0] - 2 * (X * (su[i1] - su[i0]) + Y * (sv[i1] - sv[i0])) + got * (X * X + Y * Y)
            some = i0 - o0 + o1 - i1
            step = max(1, int(len(x) * CHUNK / max(some.sum(), 1)))
            for k in range(0, len(x), step):
                w = slice(k, k + step)
                first, size = np.concatenate([o0[w], i1[w]]), np.concatenate([i0[w] - o0[w], o1[w] - i1[w]])
                j = np.repeat(np.tile(np.arange(len(x[w])), 2), size)
                q = np.arange(len(j)) + np.repeat(first - np.cumsum(size) + size, size)
                dx, dy = x[w][j] - qx[q], y[w][j] - qy[q]
                dd = dx * dx + dy * dy
                hit = np.sqrt(dd) <= r
                j, q = j[hit], q[hit]
                got[w] += np.bincount(j, qm[q], len(x[w])).astype(np.int64)
                if squares:
                    whole[w] += np.bincount(j, qm[q] * dd[hit], len(x[w]))
            n[i, t[lo:hi]] += got
            if squares:
                d2[i, t[lo:hi]] += whole
    return n, d2
