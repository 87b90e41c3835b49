"""Approximate nearest neighbours by learned partitions.

1. A bounded sample gets its exact neighbour graph. The graph is cut in two halves of equal size
   again and again: an ordering by the graph's slow modes is split at its median, then pairs of
   vertices change sides while that cuts fewer edges. This gives `parts` parts of equal size
   that keep neighbours together.
2. A small classifier (linear softmax, trained in numpy) learns where a vector's neighbours lie:
   its targets are the shares of a sample vector's neighbours in each part.
3. Every row is filed in its most probable part. A query goes to its most probable parts until
   their probabilities add up to `reach`, and meets all rows there; the inner products of
   the original vectors, in double precision, rank what it finds.

`reach` is calibrated on sample vectors that neither cut nor classifier have seen: the least
value at which `RECALL` of their true neighbours (by the inner product of the vectors as they
are, while the graph is one of angles) lie in the parts visited. Queries that find
fewer rows than wanted look into all parts.

On Spark a part meets its queries in blocks of at most `BLOCK` rows and `QUERIES_A_BLOCK`
queries, so a part or a copy group of any size is spread over tasks; each block sends on the
best rows of its queries only, and these are merged by query. Bounded by construction: the sample
(`SAMPLE_ROWS`), the parts (`PARTS`) and the classifier; everything else is tables.

Defined cases: rows with a NULL id, a NULL, empty or zero vector or a component that is NULL or
not finite take no part; shorter vectors are filled up with zeros; rows with the query's id are
not its candidates; repeated rows are candidates each, but a query that is repeated with its
vector is asked once; ties go to the smaller id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.llm.common import query, table
from panelweave.llm.vectors import best, complete, matrix, sample, size_of
from panelweave.session import cut_lineage

NEIGHBOURS = 20
SAMPLE_ROWS = 16_384
PARTS = 256  # at most
PART_ROWS = 4096  # that a part should hold while there are fewer parts than that
RECALL = 0.95  # asked of the calibration
DEGREE = 10  # edges of a vertex of the neighbour graph
BLOCK = 8192  # rows
QUERIES_A_BLOCK = 16_384


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, safe for components of any size."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places in `x` of the `k` largest inner products with each row of `q`; `own` are left out."""
    out = np.zeros((len(q), k), np.int64)
    for at in range(0, len(q), 1024):
        s = q[at : at + 1024] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[at : at + 1024]] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def graph(x: np.ndarray, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b), both ways, between each row and its nearest others."""
    k = min(degree, len(x) - 1)
    a = np.repeat(np.arange(len(x)), k)
    b = neighbours(x, x, k, np.arange(len(x))).ravel()
    return np.concatenate([a, b]), np.concatenate([b, a])


def halves(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each of `n` vertices, equally often, so that few edges (a, b) join the two."""
    degree = np.maximum(1, np.bincount(a, minlength=n))
    f = rng.normal(size=(n, 4))
    for _ in range(60):  # averaging over neighbours leaves the slow modes; the constant one is taken out
        f = 0.5 * f + 0.5 * np.stack([np.bincount(a, f[b, c], n) for c in range(4)], axis=1) / degree[:, None]
        f -= (degree[:, None] * f).sum(axis=0) / degree.sum()
        f = np.linalg.qr(f)[0]
    cut = lambda s: int((s[a] != s[b]).sum())
    sides = []
    for c in range(4):
        side = np.zeros(n, np.int64)
        side[np.argsort(f[:, c], kind="stable")[n // 2 :]] = 1
        sides.append(side)
    side = min(sides, key=cut)
    for _ in range(30):  # the vertices that would gain most change sides, as many from each side
        other = np.bincount(a, side[a] != side[b], n)
        gain = 2 * other - np.bincount(a, minlength=n)
        up, down = (s[np.argsort(-gain[s], kind="stable")] for s in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
        m = min(len(up), len(down))
        swaps = int((gain[up[:m]] + gain[down[:m]] > 0).sum())
        before, moved = cut(side), False
        while swaps:
            new = side.copy()
            new[up[:swaps]], new[down[:swaps]] = 1, 0
            if cut(new) < before:
                side, moved = new, True
                break
            swaps //= 2
        if not moved:
            break
    return side


def balanced_parts(a: np.ndarray, b: np.ndarray, n: int, parts: int, seed: int = 3) -> np.ndarray:
    """A part (from 0) for each vertex; `parts` is a power of two, sizes differ by one a level."""
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    width = 1
    while width < parts:
        new = np.zeros(n, np.int64)
        for p in range(width):
            at = np.flatnonzero(part == p)
            inner = (part[a] == p) & (part[b] == p)
            number = np.zeros(n, np.int64)
            number[at] = np.arange(len(at))
            new[at] = 2 * p + (halves(number[a[inner]], number[b[inner]], len(at), rng) if len(at) > 1 else 0)
        part, width = new, 2 * width
    return part


@dataclass
class Router:
    """Linear softmax over parts, and the probability a query's parts have to add up to."""

    weights: np.ndarray
    bias: np.ndarray
    reach: float = 1.0

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = unit(x) @ self.weights + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.chances(x).argmax(axis=1)

    def visits(self, x: np.ndarray, everything: bool = False) -> np.ndarray:
        """Which parts each row of `x` visits."""
        p = self.chances(x)
        if everything:
            return np.ones(p.shape, bool)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.take_along_axis(p, order, axis=1).cumsum(axis=1)
        before = np.concatenate([np.zeros((len(p), 1)), before[:, :-1]], axis=1)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, before < self.reach, axis=1)
        return out


def train(x: np.ndarray, share: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.05, seed: int = 9) -> Router:
    """Softmax regression of the neighbours' shares on unit vectors, by Adam."""
    rng = np.random.default_rng(seed)
    u = unit(x)
    w = [np.zeros((x.shape[1], share.shape[1])), np.zeros(share.shape[1])]
    mean, square, step = [0.0, 0.0], [0.0, 0.0], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            err = (Router(*w).chances(u[rows]) - share[rows]) / len(rows)
            step += 1
            for i, g in enumerate((u[rows].T @ err, err.sum(axis=0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w[i] = w[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*w)


def parts_for(n: int, sampled: int) -> int:
    """A power of two: `PART_ROWS` rows a part, `PARTS` at most, 64 sample rows each at least."""
    return 1 << max(0, min(n // PART_ROWS, PARTS, sampled // 64).bit_length() - 1)


def fit(x: np.ndarray, n: int, k: int = NEIGHBOURS, parts: int | None = None, recall: float = RECALL, seed: int = 1) -> Router:
    """Router for a table of `n` rows from the sample `x`."""
    parts = parts or parts_for(n, len(x))
    if parts == 1 or len(x) < 4 * k:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    order = np.random.default_rng(seed).permutation(len(x))
    asked, learned = np.split(x[order], [min(1024, len(x) // 4)])
    a, b = graph(unit(learned))
    part = balanced_parts(a, b, len(learned), parts)
    share = np.zeros((len(learned), parts))
    np.add.at(share, (a, part[b]), 1.0)
    np.add.at(share, (np.arange(len(learned)), part), 1.0)
    router = train(learned, share / share.sum(axis=1, keepdims=True))
    # probability spent before the part of each true neighbour is reached; it must stay below `reach`
    near = neighbours(asked, learned, min(k, len(learned)))
    p = router.chances(asked)
    home = router.home(learned)[near]
    spent = np.array([[row[row > row[h]].sum() for h in hs] for row, hs in zip(p, home)])
    router.reach = float(min(1.0, np.quantile(spent, recall) + 1e-6))
    return router


def _meet(dim: int, k: int):
    """The `k` best rows of a block for each query that visits it."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, v = rows["vec_id"].to_numpy(), matrix(rows["vec"], dim)
        asked, q = queries["query_id"].to_numpy(), matrix(queries["vec"], dim)
        number = queries["qid"].to_numpy()
        size = np.sqrt((v * v).sum(axis=1)).max(initial=0.0)
        found = [[], [], []]
        for at in range(0, len(q), 512):
            rough = q[at : at + 512] @ v.T
            for i, s in enumerate(rough, at):
                s[ids == asked[i]] = -np.inf
                left = len(s) - int(np.isneginf(s).sum())
                if not left:
                    continue
                # rough products choose, with room for their rounding; what is kept is summed anew in one fixed order
                least = np.partition(s, len(s) - min(k, left))[len(s) - min(k, left)]
                slack = 1e-12 * size * np.sqrt((q[i] * q[i]).sum())
                among = np.flatnonzero((s >= least - slack) & ~np.isneginf(s))
                exact = (v[among] * q[i]).sum(axis=1)
                top = best(exact, ids[among], k)
                for known, new in zip(found, (np.full(len(top), number[i]), exact[top], ids[among][top])):
                    known.append(new)
        kinds = (np.int64, np.float64, np.int64)
        return pa.table([pa.array(np.concatenate(f) if f else np.zeros(0, t)) for f, t in zip(found, kinds)], names=["qid", "score", "vec_id"])

    return run


def file_rows(rows: DataFrame, router: Router, dim: int) -> DataFrame:
    """Rows (vec_id, vec, part): every row in its most probable part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.home(matrix(b.column("vec"), dim)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=["vec_id", "vec", "part"])

    return rows.select("vec_id", "vec").mapInArrow(run, f"vec_id long, vec {rows.schema['vec'].dataType.simpleString()}, part int")


def route(queries: DataFrame, router: Router, dim: int, everything: bool = False) -> DataFrame:
    """Rows (qid, query_id, vec, part), one for each part that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, part = np.nonzero(router.visits(matrix(b.column("vec"), dim), everything))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(part.astype(np.int32))], names=["qid", "query_id", "vec", "part"])

    kind = queries.schema["vec"].dataType.simpleString()
    return queries.select("qid", "query_id", "vec").mapInArrow(run, f"qid long, query_id long, vec {kind}, part int")


def search(filed: DataFrame, queries: DataFrame, router: Router, dim: int, k: int, everything: bool = False) -> DataFrame:
    """Rows (qid, rank, vec_id, score) of the best rows in the parts that each query visits.

    `filed` and `queries` are written tables, so that the row numbers dealt here stay the same.
    """
    routed = cut_lineage(route(queries, router, dim, everything))
    blocks = filed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    groups = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_BLOCK).alias("groups"))
    sizes = F.broadcast(cut_lineage(blocks.join(groups, "part")))  # a row for each part, `PARTS` at most
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = filed.withColumn("deal", F.monotonically_increasing_id()).join(sizes, "part")
    rows = rows.select("vec_id", "vec", "part", F.pmod("deal", "blocks").alias("block"), each("groups").alias("group"))
    asked = routed.withColumn("deal", F.monotonically_increasing_id()).join(sizes, "part")
    asked = asked.select("qid", "query_id", "vec", "part", F.pmod("deal", "groups").alias("group"), each("blocks").alias("block"))
    keys = ["part", "block", "group"]
    met = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_meet(dim, k), "qid long, score double, vec_id long")
    top = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def nearest_rows(rows: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the nearest `k` found of each query."""
    all_ = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"), is_query.alias("asks"))
    all_ = all_.where(F.col("vec_id").isNotNull() & complete(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    n, dim = size_of(all_)
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(sample(all_, n, SAMPLE_ROWS, dim), n, k, parts, recall)
    filed = cut_lineage(file_rows(all_, router, dim))
    queries = all_.where("asks").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    queries = cut_lineage(queries.withColumn("qid", F.monotonically_increasing_id()))
    found = cut_lineage(search(filed, queries, router, dim, k))
    short = queries.join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.lit(n - 1)))
    short = cut_lineage(short.select(*queries.columns))
    if not short.isEmpty():
        found = found.join(short.select("qid"), "qid", "left_anti").unionByName(search(filed, short, router, dim, k, True))
    return found.join(queries.select("qid", "query_id"), "qid").select("query_id", "rank", "vec_id", "score")


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark, d):
    return nearest_rows(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)
