import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import langid
from panelweave.llm.queries import QUERIES


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ein Text, 12 längere Wörter; und noch mehr!\n" * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert np.array_equal(whole, langid.counts(text))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_on_rows_never_learned_from(spark, sf):
    d = f"/root/testdata/{sf}"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op5_language_id"](spark, d).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.99 * len(held)
    assert sum(r.rejected for r in got) < 0.02 * len(got)


@pytest.mark.parametrize("unseen", ["de", "fr"])
def test_an_unseen_language_is_rejected(spark, unseen):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs.where(F.col("lang") != unseen), F.col("doc_id"))
    assert unseen not in model.langs and 0 < model.threshold < 1
    texts = [r.text for r in docs.where(F.col("lang") == unseen).limit(300).collect()]
    assert sum(model.predict(t)[2] for t in texts) > 0.85 * len(texts)
    assert model.predict("Это совсем другой язык, который никто не учил")[2]
    known = [r.text for r in docs.where((F.col("lang") != unseen) & langid.held_out(F.col("doc_id"))).limit(500).collect()]
    assert sum(model.predict(t)[2] for t in known) < 0.02 * len(known)


def test_every_language_of_the_sample_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i % 19)}{chr(97 + i % 23)} " * 5, f"l{i % 400}") for i in range(4000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id"), sample_rows=3000)
    assert len(model.langs) > 395


def plain_prediction(model, text):
    """Average of gram scores and softmax, gram by gram."""
    data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode())
    rows = []
    for n in langid.GRAMS:
        for at in range(len(data) - n + 1):
            if data[at : at + 2] != b"  ":
                key = int.from_bytes(data[at : at + n], "big") * 2654435761 + n * 0x9E3779B9
                rows.append(model.table[(key & 0xFFFFFFFF) >> 19])
    z = (np.mean(rows, axis=0) + model.bias) / model.heat
    e = np.exp(z - z.max())
    return model.langs[int(e.argmax())], float((e / e.sum()).max())


def test_predictions_against_a_plain_twin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit_documents(docs)
    for r in docs.collect()[:60]:
        lang, score, rejected = model.predict(r.text)
        want = plain_prediction(model, r.text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-9) and rejected == (score < model.threshold)


def test_temperature_is_inside_its_bracket():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    z = rng.normal(0, 1, (400, 3))
    z[np.arange(400), y] += 2.5
    base = langid.temperature(z, y)
    for scale in (1e-4, 0.01, 30.0, 1e5):
        assert langid.temperature(z * scale, y) == pytest.approx(base * scale, rel=0.05)
    assert 0 < langid.temperature(np.eye(3)[y] * 9, y) < 9  # all right: still a finite one
    assert langid.rejection(np.full(50, 1.0)) == 0.0
    score = 1 / (1 + np.exp(-rng.exponential(1, 100_000) - 1))
    assert (score < langid.rejection(score)).mean() == pytest.approx(0.001, abs=2e-4)
    assert langid.rejection(score[:50]) < score[:50].min()


def test_scores_are_calibrated():
    """On overlapping classes the mean score of predictions is near their accuracy."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 1500)
    feats = []
    for label in y:
        b = rng.choice(40, 12, replace=False) if rng.random() < 0.3 else rng.choice(20, 12, replace=False) + 20 * label
        feats.append((np.sort(b).astype(np.int64), np.ones(12, np.float32)))
    m = langid.train(feats[:1000], [str(v) for v in y[:1000]], epochs=4)
    x = np.zeros((500, langid.BUCKETS))
    for i, (b, c) in enumerate(feats[1000:]):
        x[i, b] = c / c.sum()
    p = langid.softmax((x @ m.table + m.bias) / m.heat)
    assert abs(p.max(1).mean() - (p.argmax(1) == y[1000:]).mean()) < 0.06


def test_odd_rows(spark, odd_documents, no_documents, clashing):
    model = langid.fit_documents(odd_documents)
    got = {(r.doc_id, r.text): (r.lang_pred, r.rejected) for r in langid.identify(odd_documents, model).collect()}
    for key in [(None, None), (1, None), (2, ""), (3, " \n\t "), (7, "123 456 !!")]:
        assert got[key] == ("und", True)
    assert got[(4, "x")][0] in ("de", "en")
    empty = langid.fit_documents(no_documents)
    assert langid.identify(no_documents, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_documents, empty).collect()} == {"und"}
    assert langid.identify(clashing, model).count() == langid.recognised(clashing, model).count() == 6
