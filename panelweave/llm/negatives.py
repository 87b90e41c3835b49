"""Hard negatives by an inverted multi-index that certifies its answers.

The components of a vector become whole numbers; its first and second half are each given to the
nearest word of a codebook, and the pair of words is the row's cell. For an anchor the score of
any row of a cell (i, j) is at most

    q1 . c1[i] + |q1| r1[i]  +  q2 . c2[j] + |q2| r2[j]

with the radii r of the words (the farthest row that has the word). A multi-sequence heap over
the two sorted lists of half bounds visits cells from the highest sum down. What an anchor looks
for are windows of scores, each with a number of rows wanted: once the next cell's bound lies
below the last wanted score found in every window, or below the window itself, nothing outside
can belong to the answer. So results are those of a full comparison.

Two searches of this kind run: for the positives (one endless window, rows of the anchor's label;
cells are listed by label, so other labels are never looked at), and then for the negatives of
each positive (a window from `LOWEST` to `HIGHEST` percent of its score, rows of other labels).

On Spark a search goes in rounds. A round lets the heap of each open anchor name cells until they
hold `ROWS` rows (16 times more in each later round); named cells meet the anchors in blocks of
about `BLOCK` rows; the best rows are merged by anchor and window; certified anchors drop out.
Cells larger than a block are split, whatever their size, and the anchors of a label are planned
in groups of `ANCHORS`, so no task holds a whole cell, label or anchor list. Only the codebooks
(`WORDS` words a half at most) are in the driver, fitted on about `SAMPLE_ROWS` rows; every row
is indexed, and certificates do not depend on the sample.

Defined cases: rows with a NULL id, label or vector, or a component that is NULL or not finite,
take no part; shorter vectors are filled up with zeros; repeated rows count each, but an anchor
that is repeated with label and vector is one anchor, and rows with the anchor's id are never its
positives or negatives; scores beyond 2^62 count as 2^62; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.llm.common import query, table
from panelweave.llm.vectors import best, complete, matrix, sample, size_of
from panelweave.operators.prefix import attach_units, spread_scan
from panelweave.session import cut_lineage

SCALE = 256  # components become floor(SCALE * x)
LOWEST, HIGHEST = 80, 100  # percent of the positive's score
POSITIVES, NEGATIVES = 5, 5
SAMPLE_ROWS = 8192
WORDS = 128  # of a codebook, at most
CELL = 256  # rows a cell should hold while there are fewer words than that
BLOCK = 4096  # rows
ROWS = 4096  # that an anchor looks at in the first round
ANCHORS = 1024  # planned together
END = 1 << 62


def whole(column, dim: int, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * matrix(column, dim))


def codebook(x: np.ndarray, words: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of `words` groups of the rows of `x`, by Lloyd's algorithm."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.choice(len(distinct), min(words, len(distinct)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for k in np.flatnonzero(n):
            c[k] = x[at == k].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exact, as 64-bit integers (beyond 2^62: 2^62)."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        exact = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
        return np.clip(exact, -END, END).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def by_falling_sum(a: list[float], b: list[float]) -> Iterator[tuple[float, int, int]]:
    """(a[i] + b[j], i, j) from the highest sum down, by a heap over the two sorted lists."""
    x, y = (sorted(range(len(v)), key=lambda i: -v[i]) for v in (a, b))
    heap = [(-(a[x[0]] + b[y[0]]), 0, 0)] if x and y else []
    while heap:
        s, p, q = heapq.heappop(heap)
        yield -s, x[p], y[q]
        if q + 1 < len(y):
            heapq.heappush(heap, (-(a[x[p]] + b[y[q + 1]]), p, q + 1))
        if q == 0 and p + 1 < len(x):
            heapq.heappush(heap, (-(a[x[p + 1]] + b[y[0]]), p + 1, 0))


def half_bounds(q: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Highest score that half vectors within `r` of the words `c` can have with each row of `q`."""
    size = np.sqrt((q * q).sum(axis=1))[:, None]
    top = q @ c.T + size * r
    return top + 1e-9 * size * (np.sqrt((c * c).sum(axis=1)) + r) + 1e-3  # more than any rounding


def build_index(rows: DataFrame, n: int, dim: int, scale: int = SCALE, words: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (vec_id, label, vec, i, j, d1, d2) with the cell and the distances to its words; the codebooks."""
    x = np.floor(scale * sample(rows, n, SAMPLE_ROWS, dim))
    words = words or max(1, min(WORDS, round((n / CELL) ** 0.5)))
    half = dim // 2
    c1, c2 = codebook(x[:, :half], words), codebook(x[:, half:], words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = whole(b.column("vec"), dim, scale)
            found = []
            for part, c in ((v[:, :half], c1), (v[:, half:], c2)):
                at = nearest(part, c)
                found += [pa.array(at.astype(np.int32)), pa.array(np.sqrt(((part - c[at]) ** 2).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=["vec_id", "label", "vec", "i", "d1", "j", "d2"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"vec_id long, label {kinds['label']}, vec {kinds['vec']}, i int, d1 double, j int, d2 double"
    return cut_lineage(rows.select("vec_id", "label", "vec").mapInArrow(run, schema)), c1, c2


def cell_lists(index: DataFrame, group: Column) -> DataFrame:
    """One row for each cell of each group: its rows n, radii r1 and r2, block, parts and number (cid).

    Cells in order of (group, i, j) fill one block after the other; a cell beyond a block has parts.
    """
    c = index.groupBy(group.alias("grp"), "i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("r1"), F.max("d2").alias("r2"))
    c = spread_scan(c, [], [F.col("grp"), F.col("i"), F.col("j")], {"cid": ("sum", F.col("n"), "before")})
    c = c.withColumn("cid", F.coalesce("cid", F.lit(0)))
    return cut_lineage(c.withColumns({"block": F.floor(F.col("cid") / BLOCK), "parts": F.ceil(F.col("n") / BLOCK)}))


def _plan(c1: np.ndarray, c2: np.ndarray, dim: int, scale: int, budget: int, vec_type: pa.DataType):
    """Names the next cells of each anchor of a group."""
    half = dim // 2
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("aid", pa.int64()), ("vec", vec_type), ("cells", pa.binary()), ("seen", pa.int64()), ("next", pa.float64())])

    def run(anchors: pa.Table, cells: pa.Table) -> pa.Table:
        out = {f.name: [] for f in schema}
        q = whole(anchors["vec"], dim, scale)
        i, j, n, r1, r2, block, parts, cid = (cells[k].to_numpy() for k in ("i", "j", "n", "r1", "r2", "block", "parts", "cid"))
        (us, at1), (vs, at2) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        held = np.full((len(us), len(vs)), -1)
        held[at1, at2] = np.arange(len(i))
        far1, far2 = np.zeros(len(us)), np.zeros(len(vs))
        np.maximum.at(far1, at1, r1)
        np.maximum.at(far2, at2, r2)
        a, b = half_bounds(q[:, :half], c1[us], far1), half_bounds(q[:, half:], c2[vs], far2)
        for k, (aid, vec, need, seen) in enumerate(zip(*(anchors[c].to_pylist() for c in ("aid", "vec", "need", "seen")))):
            named, rows, nxt, count = {}, 0, None, 0
            for bound, p, r in by_falling_sum(a[k].tolist(), b[k].tolist()):
                cell = held[p, r]
                if cell < 0:
                    continue
                count += 1
                if count <= seen:
                    continue
                if bound < need or rows >= budget:
                    nxt = bound
                    break
                seen, rows = count, rows + int(n[cell])
                for part in range(parts[cell]):
                    named.setdefault((int(block[cell]), part), []).append(cid[cell])
            for (at, part), c in [((-1, 0), []), *named.items()]:  # the first one only carries the state on
                for name, v in zip(out, (at, part, aid, vec if c else None, np.array(c, np.int64).tobytes(), seen, nxt)):
                    out[name].append(v)
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def _compare(dim: int, scale: int, wanted: int, same: bool):
    """The best rows of a block in each window of the anchors that named its cells."""

    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        ids, cid = rows["vec_id"].to_numpy(), rows["cid"].to_numpy()
        labels = np.array(rows["label"].to_pylist(), object)
        v = whole(rows["vec"], dim, scale)
        q = whole(visits["vec"], dim, scale)
        names = ("aid", "anchor_id", "anchor_label", "cells", "lows", "highs")
        for at in range(0, len(q), 256):
            score = products(q[at : at + 256], v)
            for s, (aid, anchor, label, cells, lows, highs) in zip(score, zip(*(visits[c].slice(at, 256).to_pylist() for c in names))):
                in_cells = np.isin(cid, np.frombuffer(cells, np.int64))
                use = np.flatnonzero(in_cells & (ids != anchor) & ((labels == label) == same))
                mine, its = s[use], ids[use]
                for w, (low, high) in enumerate(zip(lows, highs)):
                    inside = np.flatnonzero((mine >= low) & (mine <= high))
                    top = inside[best(mine[inside], its[inside], wanted)]
                    for known, new in zip(found, ([aid] * len(top), [w] * len(top), mine[top].tolist(), its[top].tolist())):
                        known += new
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["aid", "win", "score", "vec_id"])

    return run


def windows_search(index: DataFrame, books: tuple[np.ndarray, np.ndarray], anchors: DataFrame, by_label: bool, wanted: int, dim: int, scale: int = SCALE) -> DataFrame:
    """Rows (aid, win, rank, score, vec_id): the first `wanted` rows of each window of each anchor.

    `anchors` has rows (aid, anchor_id, anchor_label, vec, lows, highs) with one low and high score
    a window. `by_label` looks at rows of the anchor's label, otherwise at all rows of other labels.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    group = lambda c: F.col(c) if by_label else F.lit(0)
    lists = cell_lists(index, group("label"))
    placed = attach_units(index.withColumn("grp", group("label")), lists.select("grp", "i", "j", "block", "parts", "cid"), ["grp", "i", "j"], written=True)
    part = F.when(F.col("parts") > 1, F.pmod(F.monotonically_increasing_id(), F.col("parts"))).otherwise(0)
    placed = cut_lineage(placed.select("vec_id", "label", "vec", "block", part.alias("part"), "cid"))
    vec_type = to_arrow_type(index.schema["vec"].dataType)
    types = {f.name: f.dataType.simpleString() for f in index.schema.fields}
    need = F.array_min(F.transform(F.filter(F.arrays_zip("lows", "highs"), lambda w: w["lows"] <= w["highs"]), lambda w: w["lows"])).cast("double")
    open_ = cut_lineage(anchors.withColumn("grp", group("anchor_label")).withColumns({"need": need, "seen": F.lit(0).cast("long")}).where("need IS NOT NULL"))
    top = W.partitionBy("aid", "win").orderBy(F.desc("score"), "vec_id")
    known, budget = None, ROWS
    while True:
        counts = cut_lineage(open_.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("chunks")))
        if counts.isEmpty():
            break
        their = lists.join(counts, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        asking = attach_units(open_.select("aid", "vec", "need", "seen", "grp"), counts, ["grp"], written=True)
        asking = asking.withColumn("chunk", F.pmod(F.xxhash64("aid"), F.col("chunks"))).drop("chunks")
        plan = _plan(*books, dim, scale, budget, vec_type)
        planned = asking.groupBy("grp", "chunk").cogroup(their.groupBy("grp", "chunk")).applyInArrow(
            plan, f"block long, part long, aid long, vec {types['vec']}, cells binary, seen long, next double"
        )
        planned = cut_lineage(planned)
        visits = planned.where("block >= 0").select("block", "part", "aid", "vec", "cells")
        visits = visits.join(open_.select("aid", "anchor_id", "anchor_label", "lows", "highs"), "aid")
        rows = placed.join(visits.select("block", "part").distinct(), ["block", "part"], "left_semi")
        new = rows.groupBy("block", "part").cogroup(visits.groupBy("block", "part")).applyInArrow(
            _compare(dim, scale, wanted, by_label), "aid long, win int, score long, vec_id long"
        )
        both = new if known is None else known.drop("rank").unionByName(new)
        known = cut_lineage(both.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= wanted))
        # a window is certain once the next bound is below its last wanted score, or below itself
        last = known.groupBy("aid", "win").agg(F.max("rank").alias("n"), F.min("score").alias("last")).where(F.col("n") == wanted)
        now = open_.select("aid", F.posexplode(F.arrays_zip("lows", "highs")).alias("win", "w")).where("w.lows <= w.highs")
        now = now.join(last, ["aid", "win"], "left").groupBy("aid").agg(F.min(F.greatest(F.col("w.lows"), F.col("last"))).cast("double").alias("need"))
        state = planned.where("block < 0").select("aid", "seen", "next").join(now, "aid").where(F.col("next") >= F.col("need")).drop("next")
        open_ = cut_lineage(open_.drop("need", "seen").join(state, "aid"))
        budget *= 16
    return known if known is not None else index.sparkSession.createDataFrame([], "aid long, win int, score long, vec_id long, rank int")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
    words: int | None = None,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    all_ = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("vec"), is_anchor.alias("asks"))
    all_ = all_.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & complete(F.col("vec")))
    n, dim = size_of(all_)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    index, *books = build_index(all_, n, dim, scale, words)
    anchors = all_.where("asks").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "vec").distinct()
    anchors = cut_lineage(anchors.withColumn("aid", F.monotonically_increasing_id()))
    endless = [F.array(F.lit(v).cast("long")).alias(k) for k, v in (("lows", -END), ("highs", END))]
    found = windows_search(index, books, anchors.select("*", *endless), True, positives, dim, scale)
    percent = lambda p, x: F.col(x).cast("decimal(20,0)") * p / 100
    p = found.withColumns({"low": F.ceil(percent(lowest, "score")).cast("long"), "high": F.floor(percent(highest, "score")).cast("long")})
    # at most `positives` rows an anchor
    p = p.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "low", "high"))).alias("p"))
    p = cut_lineage(anchors.join(p, "aid"))
    asked = p.select(*anchors.columns, F.col("p.low").alias("lows"), F.col("p.high").alias("highs"))
    got = windows_search(index, books, asked, False, negatives, dim, scale)
    pairs = got.join(p.select("aid", "anchor_id", "p"), "aid")
    of = lambda c: F.get("p", F.col("win"))[c]
    return pairs.select(
        "anchor_id", of("vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), of("score").alias("positive_score"), F.col("score").alias("negative_score")
    )


_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
  n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= {HIGHEST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""


@query("op11_hard_negatives", _SQL)
def op11_hard_negatives(spark, d):
    rows = table(spark, d, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
