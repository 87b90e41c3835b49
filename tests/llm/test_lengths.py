import numpy as np
import pytest

from panelweave.llm import lengths
from panelweave.llm.queries import QUERIES


def test_pieces_keep_the_tokens():
    text = "Some words,  and\n\nlines é ü 123 'tis  " * 200
    whole = len(lengths.encoder().encode_ordinary(text))
    for size in (7, 50, 1000):
        assert "".join(lengths.pieces(text, size)) == text
        assert sum(len(lengths.encoder().encode_ordinary(p)) for p in lengths.pieces(text, size)) == whole


def check(histogram, values):
    v = np.sort(np.array(values))
    rows = sorted(histogram.collect())
    assert [r.n_tokens for r in rows] == np.unique(v).tolist()
    for r in rows:
        n = r.n_tokens
        assert r.n_docs == (v == n).sum() and r.docs_upto == (v <= n).sum() and r.docs_from == (v >= n).sum()
        assert r.tokens_from == v[v >= n].sum() and r.truncated_total == np.minimum(v, n).sum()


def test_sums_limits_and_quantiles(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 40, 100), rng.integers(0, 9000, 60), [0, 1023, 1024, 250_000]])
    h = lengths.length_histogram(spark.createDataFrame([(int(x),) for x in values], "n_tokens long"))
    check(h, values)
    limits = [0, 1, 39, 512, 1023, 1024, 5000, 249_999, 250_000, 10**7]
    got = {r.context: r for r in lengths.at_limits(h, spark.createDataFrame([(x,) for x in limits], "context long")).collect()}
    for x in limits:
        assert got[x].docs_over == (values > x).sum()
        assert got[x].tokens_over == np.maximum(values - x, 0).sum()
        assert got[x].truncated_total == np.minimum(values, x).sum()
    probs = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {r.p: r.n_tokens for r in lengths.at_quantiles(h, probs).collect()}
    assert got == {p: np.quantile(values, p, method="inverted_cdf") for p in probs}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(QUERIES["op6_token_length_histogram"](spark, d), [len(lengths.encoder().encode_ordinary(t)) for t in texts])


def test_odd_rows(odd_documents, no_documents, clashing):
    got = lengths.length_histogram(lengths.token_counts(odd_documents)).collect()
    assert sum(r.n_docs for r in got) == odd_documents.count()
    assert [r.n_docs for r in got if r.n_tokens == 0] == [3]
    assert lengths.length_histogram(lengths.token_counts(no_documents)).count() == 0
    assert lengths.token_counts(clashing, keep=["doc_id"]).count() == 6


@pytest.mark.parametrize("text", ["\ud800 lone", "x" * 50_000, " " * 300_000])
def test_odd_texts(text):
    assert lengths.n_tokens(text) > 0
