import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import partitions
from panelweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    """{query: [(vec_id, score) of the k nearest]} by comparing everything."""
    ok = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            scored = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in ok if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def bunches(n, dim=16, groups=40, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 1, (groups, dim))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(c[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dim)))]


def test_parts_are_balanced_and_keep_neighbours_together():
    x = np.array([v for _, v in bunches(1200)])
    a, b = partitions.graph(partitions.unit(x))
    part = partitions.balanced_parts(a, b, len(x), 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3
    random = np.random.default_rng(1).permutation(part)
    assert (part[a] != part[b]).mean() < 0.35 < (random[a] != random[b]).mean()


def test_router_skips_rows_where_vectors_bunch():
    x = np.array([v for _, v in bunches(3000)])
    router = partitions.fit(x, 100_000, parts=16)
    visits = router.visits(x[::20])
    home = router.home(x)
    near = partitions.neighbours(x[::20], x, 20, np.arange(0, 3000, 20))
    assert np.take_along_axis(visits, home[near], axis=1).mean() > 0.9
    assert (visits @ np.bincount(home, minlength=16)).mean() < 0.6 * len(x)


@pytest.mark.parametrize("blocks", [(8192, 16_384), (90, 20)])
def test_recall_and_scores(spark, monkeypatch, blocks):
    monkeypatch.setattr(partitions, "BLOCK", blocks[0])
    monkeypatch.setattr(partitions, "QUERIES_A_BLOCK", blocks[1])
    rows = bunches(1500)
    rows += [(5000 + i, rows[3][1]) for i in range(400)]  # a hot vector
    got = found(partitions.nearest_rows(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, parts=8))
    want = brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    vectors = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0])) and q not in dict(near)
        for i, s in near:
            assert s == float((np.array(vectors[q], np.float64) * np.array(vectors[i], np.float64)).sum())
    # with all parts open the answer is that of a full comparison, ties included
    everything = found(partitions.nearest_rows(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, parts=1))
    assert everything == want


def test_few_rows_in_the_visited_parts(spark, monkeypatch):
    """Queries whose parts are too thin look everywhere."""
    narrow = partitions.fit
    monkeypatch.setattr(partitions, "fit", lambda *a, **k: (r := narrow(*a, **k), setattr(r, "reach", 1e-9))[0])
    rows = bunches(300)
    got = found(partitions.nearest_rows(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=60, parts=8))
    assert all(len(v) == 60 for v in got.values()) and len(got) == 6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op13_nearest_neighbours"](spark, d)), brute(rows, 20, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, None), (5, [1.0, None]), (6, [nan, 1.0])]
    rows += [(7, [inf, 1.0]), (8, [0.0, 0.0]), (20, [3e38, -3e38, 1.0]), (40, [0.0]), (60, [-1.0, -1.0]), (9, [1e-40, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    pad = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))]) for i, v in rows]
    want = brute(pad, 20, 20)
    want[0] = want[0][: len(want[0])]
    query = F.col("vec_id") % 20 == 0
    assert found(partitions.nearest_rows(df, query)) == want
    assert partitions.nearest_rows(df.limit(0), query).count() == 0
    assert partitions.nearest_rows(df.where("vec_id = 8"), query).count() == 0
    assert partitions.nearest_rows(df.where("vec_id = 20"), query).count() == 0
    names = "part block group blocks groups deal qid rank score vec asks query_id".split()
    assert found(partitions.nearest_rows(df.select("*", *[F.lit(1).alias(c) for c in names]), query)) == want
