import re

import numpy as np
import pytest

import corpus_pipeline
from panelweave.llm import langid, secrets
from test_decontaminate import plain
from test_mixing import brute_targets
from test_secrets import brute
from test_simhash import brute_components, brute_fingerprint

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before each stage and after the last."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_each_stage_against_brute_force(spark, steps):
    start, lang, near, clean, safe, mixed = steps
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["language ID", "SimHash near-dedup"]
    model = langid.fit_documents(spark.createDataFrame(start, spark.read.parquet(f"{D}/documents.parquet").schema))
    assert {r.doc_id for r in lang} == {r.doc_id for r in start if not model.predict(r.text)[2]}

    fps = [brute_fingerprint(r.text) for r in lang]
    least = brute_components([r.doc_id for r in lang], fps)
    assert sorted(r.doc_id for r in near) == sorted(set(least))

    items = spark.read.parquet(f"{D}/benchmark.parquet").collect()
    bad = {d for d, _ in plain(near, items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in near} - bad

    old = {r.doc_id: r for r in clean}
    assert {r.doc_id for r in safe} == set(old)
    for r in safe:
        assert brute(r.text) == [] and r.n_chars == len(r.text)
        if not secrets.find_secrets(old[r.doc_id].text):
            assert r == old[r.doc_id]

    assert len({r.doc_id for r in mixed}) == len(mixed)
    totals, taken = {}, {}
    for r in safe:
        totals[r.source] = totals.get(r.source, 0) + len(r.text.encode().split())
    for r in mixed:
        assert r["size"] == len(r.text.encode().split()) and 0 < r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_targets(totals)
    assert all(0 <= want[s] + 0.5 - taken.get(s, 0) <= max(len(r.text.split()) for r in safe if r.source == s) + 1 for s in want)


def test_run_is_the_chain_of_stages(spark, steps):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, D).collect()) == sorted(r.doc_id for r in steps[-1])


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd_documents, no_documents, clashing, k):
    name, stage = corpus_pipeline.STAGES[k]
    kept = stage(spark, odd_documents, D)
    assert kept.columns[:5] == odd_documents.columns and (k == 4 or len(kept.columns) == 5)
    assert 0 < kept.count() <= odd_documents.count()
    assert stage(spark, no_documents, D).count() == 0
    other = stage(spark, clashing, D)
    assert len(set(other.columns)) == len(other.columns) and set(clashing.columns) <= set(other.columns)
    assert 0 < len(other.collect()) <= 6
    if k < 4:
        assert other.columns == clashing.columns and other.where("__row_hash <> 1").isEmpty()


def test_rows_of_one_id_are_apart(spark, documents):
    """A bad row does not take a good one with it."""
    item = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    rng = np.random.default_rng(1)
    prose = " ".join(f"word{x}" for x in rng.integers(0, 10**6, 60))
    docs = documents([(1, item + " " + item, "en", "s"), (1, prose, "en", "s"), (1, prose, "en", "s"), (None, prose + " more", "en", "s")])
    kept = corpus_pipeline.STAGES[2][1](spark, docs, D).collect()
    assert sorted(r.text for r in kept) == sorted([prose, prose, prose + " more"])
    assert not re.search("[A-Z]", prose)
    assert corpus_pipeline.STAGES[1][1](spark, documents([(7, prose), (7, prose), (7, None)]), D).count() == 2
