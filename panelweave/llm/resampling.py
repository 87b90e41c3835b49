"""Importance resampling of documents towards a target text collection.

Features are runs of 1 to `ngrams` consecutive words, hashed to `BUCKETS` buckets. The logarithm
of how much more frequent a bucket is in the target than in the documents is its gain; a
document's weight is the mean gain of its features. Gumbel noise from a seeded hash of the id
turns the highest scores into a draw without replacement in proportion to exp(weight / 1000).

Words are found batch by batch. The texts of a batch are joined with a separator that no word
can hold, one pass of a regular expression finds all words with their places, a binary search
of the documents' offsets tells whose they are, and runs of words that cross a border are masked
before one `bincount`. A text beyond `BATCH_BYTES` is read in parts that end between words; the
last words of a part are carried into the next, so no run is lost and none counts twice.

Two passes over the texts: one for the bucket counts (a table of `BUCKETS` rows, whatever the
input), one for the weights. Scores are numbered by ranges, so no task sees all of them.

Defined cases: NULL text has no words, weight 0 and is never drawn (fewer than `MIN_WORDS`
words); rows are weighed one by one, so repeated rows stay and rows with equal id and score get
ranks one after the other in any order (nothing else tells them apart in the result unless
their texts differ; then more features come first); a NULL id is hashed as empty and is the
last of a tie; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import query, table
from panelweave.operators.prefix import spread_scan
from panelweave.session import cut_lineage

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
BATCH_BYTES = 1 << 20
SEPARATOR = b"\x00"

# A word: digits, small letters and everything beyond ASCII. Bytes of a longer UTF-8 sequence are
# all beyond ASCII, so the pattern finds the same words in bytes as in text.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def features(texts: list[bytes], ngrams: int = 1, seen: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document of each feature, bucket of each feature, words of each document, last words).

    One regex pass over all texts. `seen` words at the start of the first text were read before:
    runs that lie within them are left out, as are they from the word counts.
    """
    ends = np.fromiter(accumulate(len(t) + 1 for t in texts), np.int64, len(texts))
    joined = SEPARATOR.join(texts).lower()
    found = [(m.start(), m[0]) for m in _WORD.finditer(joined)]
    words = [w for _, w in found]
    doc = np.searchsorted(ends, np.fromiter((at for at, _ in found), np.int64, len(found)), side="right")
    docs, hashed, run = [], [], None
    spaced = [b" " + w for w in words] if ngrams > 1 else []
    for n in range(1, ngrams + 1):
        if n > len(words):
            break
        # the checksum of a longer run goes on from that of the run without its last word
        run = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) if n == 1 else np.fromiter(map(zlib.crc32, spaced[n - 1 :], run[:-1].tolist()), np.int64, len(words) - n + 1)
        first, last = doc[: len(doc) - n + 1], doc[n - 1 :]
        inside = (first == last) & (np.arange(len(run)) + n > seen)
        docs.append(first[inside])
        hashed.append(run[inside] % BUCKETS)
    none = np.zeros(0, np.int64)
    n_words = np.bincount(doc[seen:], minlength=len(texts)).astype(np.int64)
    return np.concatenate(docs or [none]), np.concatenate(hashed or [none]), n_words, words[max(0, len(words) - ngrams + 1) :] if ngrams > 1 else []


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """`text` in parts of about `size` bytes that end where no word goes on."""
    at = 0
    while len(text) - at > size:
        m = _BREAK.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def long_features(text: bytes, ngrams: int, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets, words) of each part of one text."""
    carried: list[bytes] = []
    for part in parts(text, size):
        _, b, n, carried = features([b" ".join([*carried, part])], ngrams, len(carried))
        yield b, int(n[0])


def groups(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts that together hold at most `size` bytes, or one text."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text_col: str = "text", ngrams: int = 1, size: int = BATCH_BYTES) -> DataFrame:
    """Rows (bucket, n) over all texts. A task sends each bucket at most once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            t = _bytes(batch.column(0))
            for a, b in groups(t, size):
                found = [features(t[a:b], ngrams)[1]] if b - a > 1 or len(t[a]) <= size else (f for f, _ in long_features(t[a], ngrams, size))
                for f in found:
                    total += np.bincount(f, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket long, n long")
    return got.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", ngrams: int = 1) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed document share)) of each bucket: `BUCKETS` numbers."""
    both = [np.zeros(BUCKETS, np.int64) for _ in range(2)]
    for counts, texts in zip(both, (docs, target)):
        for r in bucket_counts(texts, text_col, ngrams).collect():
            counts[r.bucket] = r.n
    s, t = both
    ratio = (t + 1.0) * float(s.sum() + BUCKETS) / ((s + 1.0) * float(t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngrams: int = 1, size: int = BATCH_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight), one for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            t = _bytes(batch.column(1))
            words, number, total = (np.zeros(len(t), np.int64) for _ in range(3))
            for a, b in groups(t, size):
                if b - a > 1 or len(t[a]) <= size:
                    doc, bucket, words[a:b], _ = features(t[a:b], ngrams)
                    number[a:b] = np.bincount(doc, minlength=b - a)
                    total[a:b] = np.bincount(doc, g[bucket], b - a).astype(np.int64)  # whole numbers, exact
                else:
                    for bucket, n in long_features(t[a], ngrams, size):
                        words[a], number[a], total[a] = words[a] + n, number[a] + len(bucket), total[a] + g[bucket].sum()
            weight = np.where(number > 0, total // np.maximum(1, number), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, number, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """floor(1000 times Gumbel noise) from the first 32 bits of SHA-256 of `seed:id`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngrams: int = 1, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank): ranks of the drawn, NULL for all others."""
    w = weigh(docs, gains(docs, target, text_col, ngrams), id_col, text_col, ngrams)
    w = cut_lineage(w.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    draw = w.where(F.col("n_words") >= min_words).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("weight").desc()]
    numbered = spread_scan(w.where(F.col("n_words") >= min_words), [], order, {"place": ("sum", F.lit(1), "upto")})
    drawn = numbered.select(*out, F.when(F.col("place") <= draw, F.col("place").cast("long")).alias("rank"))
    return drawn.unionByName(w.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))


def _sql() -> str:
    """The same draw in SQL; the checksum goes byte by byte over each distinct word."""
    words = lambda t: f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {t}"
    return f"""
WITH RECURSIVE bits AS (SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
  tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
  d AS (SELECT doc_id, {words('documents')}), i AS (SELECT {words('benchmark')}),
  dw AS (SELECT doc_id, unnest(ws) AS w FROM d), iw AS (SELECT unnest(ws) AS w FROM i),
  vocab AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM iw)),
  steps AS (SELECT w, x, 4294967295::BIGINT AS c, 1 AS p FROM vocab
    UNION ALL SELECT w, x, xor(t[xor(c & 255, ('0x' || substr(x, p, 2))::BIGINT) + 1], c >> 8), p + 2 FROM steps, tab WHERE p < length(x)),
  hashed AS (SELECT w, xor(c, 4294967295) % {BUCKETS} AS bucket FROM steps WHERE p > length(x)),
  s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM iw JOIN hashed USING (w) GROUP BY 1),
  sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
  gain AS (SELECT b.range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (sums.s + {BUCKETS}) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (sums.t + {BUCKETS}))))::BIGINT AS g
    FROM range({BUCKETS}) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range CROSS JOIN sums),
  mean AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
  scored AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN mean USING (doc_id)),
  placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT scored.*, CASE WHEN place <= n * {PERCENT} // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


@query("op12_importance_resample", _sql())
def op12_importance_resample(spark, d):
    return resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
