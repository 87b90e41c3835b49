import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import mixing
from panelweave.llm.queries import QUERIES


def brute_targets(sizes):
    """Reshare round by round, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), list(names)
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in open_)
        target = {s: min(t, 2 * sizes[s]) for s, t in target.items()}
        open_ = [s for s in open_ if target[s] < 2 * sizes[s] - 1e-9]
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 7, "B": 300, "é": 0}, {"x": 5}, {"x": 0, None: 0}, {f"s{i}": 10 ** (i % 5) for i in range(17)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes), rel=1e-9, abs=1e-6)


def test_fit_counts_hits_reachable_budgets():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 8)))
        have = rng.integers(1, 6, len(lengths))
        reach = {0}
        for length, n in zip(lengths, have):
            reach = {s + length * k for s in reach for k in range(n + 1)}
        budget = int(rng.integers(0, (lengths * have).sum() + 5))
        take = mixing.fit_counts(lengths, have, budget)
        assert (take >= 0).all() and (take <= have).all()
        got = int((lengths * take).sum())
        assert got <= budget and got in reach
        assert got == max(s for s in reach if s <= budget)


def test_fit_counts_large():
    rng = np.random.default_rng(2)
    lengths, have = np.arange(1, 5000), rng.integers(1, 400, 4999)
    total = int((lengths * have).sum())
    for share in (0.1, 0.5, 0.999):
        take = mixing.fit_counts(lengths, have, int(total * share))
        assert int((lengths * take).sum()) == int(total * share) and (take <= have).all() and (take >= 0).all()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    got = QUERIES["op9_mix_to_targets"](spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    totals, taken = {}, {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        totals[source[r.doc_id]] = totals.get(source[r.doc_id], 0) + r["size"]
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    want = brute_targets(totals)
    for r in got:
        assert r.source_size == totals[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    for s in want:  # the nearest sum from below of all that the source's documents can reach
        whole = min(2, int(want[s] // totals[s]))
        sums = 1
        for i in size:
            if source[i] == s:
                sums |= sums << size[i]
        rest = round(want[s] - whole * totals[s])
        assert taken[s] - whole * totals[s] == max(x for x in range(rest + 1) if sums >> x & 1)
    assert sorted(got) == sorted(QUERIES["op9_mix_to_targets"](spark, d).collect())


def test_odd_rows(odd_documents, no_documents, clashing):
    got = mixing.mix(odd_documents).collect()
    assert len(got) == odd_documents.count() and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mix(clashing, key="k").agg(F.sum("taken")).first()[0] > 0
