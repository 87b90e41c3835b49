import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelweave.llm import resampling
from panelweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text, ngrams=1):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, ngrams=1, percent=10):
    """Rows (doc_id, n_features, weight, score, rank) from lists of (id, text) and of texts."""
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(brute_features(x, ngrams)[0])
    for x in target:
        t.update(brute_features(x, ngrams)[0])
    S, T, out = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    for i, x in docs:
        f, n = brute_features(x, ngrams)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for place, r in enumerate(long[: len(long) * percent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


TEXTS = ["One two THREE two", "", "é1 ÀB àb ſ K", "x\x00y z-z", "..", "日本 語", "a" * 50, "three\ntwo one", "\x00"]


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_features_of_a_batch(ngrams):
    doc, bucket, n, _ = resampling.features([t.encode() for t in TEXTS], ngrams)
    for i, t in enumerate(TEXTS):
        want, words = brute_features(t, ngrams)
        assert sorted(bucket[doc == i].tolist()) == sorted(want) and n[i] == words


@pytest.mark.parametrize("ngrams", [1, 2, 4])
@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_parts_of_a_long_text(ngrams, size):
    text = " ".join(f"w{i % 13}é{'x' * (i % 9)}" for i in range(300))
    got = list(resampling.long_features(text.encode(), ngrams, size))
    want, words = brute_features(text, ngrams)
    assert sorted(np.concatenate([b for b, _ in got]).tolist()) == sorted(want) and sum(n for _, n in got) == words


@pytest.mark.parametrize("ngrams", [1, 2])
def test_query_against_brute_force(spark, ngrams):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()], ngrams)
    got = QUERIES["op12_importance_resample"](spark, d) if ngrams == 1 else resampling.resample(docs, items, ngrams=ngrams)
    assert rows(got) == want and any(r[4] for r in want)


def test_odd_rows(spark, odd_documents, no_documents, clashing):
    items = spark.createDataFrame([(1, "lorem ipsum das ist"), (2, None), (2, "")], "item_id long, text string")
    none = items.limit(0)
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert rows(resampling.resample(odd_documents, items, percent=100)) == brute(docs, ["lorem ipsum das ist"], percent=100)
    assert rows(resampling.resample(odd_documents, none)) == brute(docs, [])
    assert resampling.resample(no_documents, items).count() == 0
    assert resampling.resample(no_documents, none).count() == 0
    assert resampling.resample(clashing, items).columns == ["doc_id", "n_features", "weight", "score", "rank"]
