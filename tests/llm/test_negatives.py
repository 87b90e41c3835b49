import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import negatives
from panelweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, lowest=80, highest=100, wanted=5):
    """Plain comparison of everything, in Python's whole numbers."""
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    full = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in ok]
    clip = lambda s: max(-(1 << 62), min(1 << 62, s))
    out = []
    for a, v, lab in sorted(set((i, tuple(v), lab) for i, v, lab in full)):
        if a % every:
            continue
        scored = [(-clip(sum(x * y for x, y in zip(v, w))), i, other) for i, w, other in full if i != a]
        for s, p, _ in sorted(r for r in scored if r[2] == lab)[:wanted]:
            fits = sorted(r for r in scored if r[2] != lab and lowest * -s <= 100 * -r[0] <= highest * -s)
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits[:wanted])]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_heap_goes_down():
    rng = np.random.default_rng(0)
    for n, m in ((0, 3), (1, 1), (5, 9), (30, 2)):
        a, b = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, m).tolist()
        got = list(negatives.by_falling_sum(a, b))
        assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(n) for j in range(m)]
        assert [s for s, _, _ in got] == sorted((x + y for x in a for y in b), reverse=True)
        assert all(s == a[i] + b[j] for s, i, j in got)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = np.floor(rng.normal(0, 90, (500, 7))), np.floor(rng.normal(0, 90, (20, 7)))
    c = negatives.codebook(x, 9)
    at = negatives.nearest(x, c)
    r = np.array([max((np.linalg.norm(v - c[k]) for v in x[at == k]), default=0) for k in range(len(c))])
    assert (negatives.half_bounds(q, c, r)[:, at] >= q @ x.T).all()


def test_products_are_exact():
    a, b = np.array([[2.0**70, 3.0], [1.0, -5.0]]), np.array([[2.0**30, 1.0], [0.0, 7.0]])
    assert negatives.products(a, b).tolist() == [[1 << 62, 21], [2**30 - 5, -35]]


def clustered(n, dim=12, labels=4, seed=3):
    """Vectors in bunches, so that bounds cut most cells off."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (20, dim))
    v = centres[rng.integers(0, 20, n)] + rng.normal(0, 0.05, (n, dim))
    return [(i, [float(x) for x in np.float32(r)], int(lab)) for i, (r, lab) in enumerate(zip(v, rng.integers(0, labels, n)))]


@pytest.mark.parametrize("sizes", [(4096, 4096, 1024), (32, 16, 3)])
def test_against_brute_force(spark, monkeypatch, sizes):
    """Also with blocks, rounds and groups so small that cells are split and rounds repeat."""
    for name, v in zip(("BLOCK", "ROWS", "ANCHORS"), sizes):
        monkeypatch.setattr(negatives, name, v)
    rows = clustered(600)
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(150)]  # a hot vector
    rows += [(2000 + i, rows[7][1], 3 - rows[7][2]) for i in range(80)]
    got = rows_of(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, words=6))
    want = brute(rows, 20)
    assert got == want and len(want) > 100


def test_certificate_spares_cells(spark, monkeypatch):
    """On bunched vectors most rows are never compared."""
    rows = clustered(4000, seed=5)
    named = []
    plan = negatives._plan

    def counting(*a):
        fn = plan(*a)

        def run(anchors, cells):
            out = fn(anchors, cells)
            n = dict(zip(cells["cid"].to_pylist(), cells["n"].to_pylist()))
            named.append(sum(n[int(c)] for b in out["cells"].to_pylist() for c in np.frombuffer(b, np.int64)))
            return out

        return run

    df = spark.createDataFrame(rows, SCHEMA)
    n, dim = len(rows), 12
    index, *books = negatives.build_index(df.withColumnRenamed("embedding", "vec"), n, dim, words=16)
    cells = negatives.cell_lists(index, F.lit(0)).toArrow()
    import pyarrow as pa

    asked = rows[:40]
    anchors = pa.table({"aid": list(range(40)), "vec": pa.array([r[1] for r in asked], pa.list_(pa.float32())), "need": [0.9 * sum(math.floor(256 * x) ** 2 for x in r[1]) for r in asked], "seen": [0] * 40})
    counting(*books, dim, 256, 10**9, pa.list_(pa.float32()))(anchors, cells)
    assert named[0] < 0.35 * 40 * n


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op11_hard_negatives"](spark, d)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [], 2), (4, None, 2)]
    rows += [(5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [1.0, 1.9], 2), (9, [1.0, 1.9], 2), (10, [1.0, 1.9], None), (100, [3e38, -3e38, 1.0], 1)]
    rows += [(200, [-1.0, -1.0], 2), (300, [0.0, 0.0], 3), (11, [3e38, 1.0], 2), (12, [3e38, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    pad = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))], lab) for i, v, lab in rows]
    assert rows_of(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == brute(pad)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    names = "aid grp need seen block part cid i j d1 d2 rank score win vec asks".split()
    clash = df.select("*", *[F.lit(1).alias(c) for c in names])
    assert rows_of(negatives.hard_negatives(clash, F.col("vec_id") % 100 == 0)) == brute(pad)
