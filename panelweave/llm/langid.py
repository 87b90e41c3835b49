"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters (lower case, everything else a break) give byte 2-, 3- and 4-grams; each hashes
to one of `BUCKETS` embeddings, the whole text is the average of its grams, and a linear layer
with softmax gives the languages. Both layers are trained by stochastic gradient descent in
numpy on the driver, on a bounded sample: about `SAMPLE_ROWS` labelled rows, as many of each
language, chosen by a hash of the id; every language of the sample is learned. A fifth of the
sample is kept from training and calibrates a temperature (so that scores are probabilities) and
the rejection threshold (the score below which only `REJECTED` of the well-labelled texts fall,
carried on beyond the lowest score seen where the sample is too small to show it).

Averaging and the linear layer commute, so prediction looks up one score vector per bucket.
Whole texts are read, in pieces of bounded size.

Defined cases: NULL text and text without a letter give `und`, score 0 and are rejected; rows
are predicted one by one, so repeated rows and NULL ids need nothing special; without any
labelled row everything is `und`. Columns other than id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import by_batch, query, table
from panelweave.operators.prefix import attach_units
from panelweave.session import cut_lineage

BUCKETS = 1 << 13
WIDTH = 16  # of an embedding
GRAMS = (2, 3, 4)
SAMPLE_ROWS = 4000
STEPS = 600  # of gradient descent at least, however small the sample
REJECTED = 0.001
PIECE = 1 << 20  # bytes looked at together
UNKNOWN = "und"

# ASCII bytes that are no letters become spaces, capitals small; other bytes stay.
_FOLD = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all grams of `text`, piece by piece."""
    data = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + max(GRAMS) - 1]
        for n in GRAMS:
            starts = min(PIECE, len(part) - n + 1)
            if starts <= 0:
                continue
            gram = part[:starts].copy()
            for k in range(1, n):
                gram = (gram << np.uint32(8)) | part[k : k + starts]
            words = gram[~((part[:starts] == 32) & (part[1 : starts + 1] == 32))]
            yield ((words * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(19)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for b in buckets(text):
        total += np.bincount(b, minlength=BUCKETS)
    return total


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times output weights
    bias: np.ndarray
    heat: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        c = counts(text)
        p = softmax((c @ self.table / max(1, c.sum()) + self.bias)[None] / self.heat)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, rate: float = 20.0, batch: int = 32, seed: int = 7, least_steps: int = STEPS) -> Model:
    """Fit by mini-batch gradient descent; `features` are (buckets, counts) of each text."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.searchsorted(langs, labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    fit = order[len(y) // 5 :] if len(y) >= 5 else order
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)

    def dense(rows):
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            b, c = features[r]
            x[i, b] = c / max(1, c.sum())
        return x

    epochs = max(epochs, -(-least_steps // -(-len(fit) // batch)))
    steps, done = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            x, lr = dense(rows), rate * (1 - done / steps)
            mean = x @ emb
            err = softmax(mean @ out + bias)
            err[np.arange(len(rows)), y[rows]] -= 1
            err /= len(rows)
            step_emb = x.T @ (err @ out.T)
            out -= 0.05 * lr * (mean.T @ err)
            bias -= 0.01 * lr * err.sum(axis=0)
            emb -= lr * step_emb
            done += 1

    def logits(rows):
        parts = [dense(rows[i : i + 256]) @ emb @ out + bias for i in range(0, len(rows), 256)]
        return np.concatenate(parts).astype(np.float64)

    seen = held if len(held) else fit
    z = logits(seen)
    heat = temperature(z, y[seen])
    p = softmax(z / heat)
    right = p.argmax(axis=1) == y[seen]
    # fewer than five rows leave none to calibrate with: nothing is rejected for its score
    threshold = rejection(p.max(axis=1)[right]) if len(held) else 0.0
    return Model(langs, (emb @ out).astype(np.float64), bias.astype(np.float64), heat, threshold)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss on logits `z`.

    One of n + 2 labels counts as wrong (the rule of succession), so that the loss has a minimum
    even where all are right; the grid is widened until it brackets that minimum.
    """
    n, k = z.shape
    if k < 2:
        return 1.0
    wrong = 1 / (n + 2)
    target = np.full((n, k), wrong / (k - 1))
    target[np.arange(n), y] = 1 - wrong
    loss = lambda t: -(target * np.log(np.maximum(softmax(z / t), 1e-300))).sum(axis=1).mean()
    low, high = 0.05, 20.0
    for _ in range(20):
        grid = np.geomspace(low, high, 61)
        best = int(np.argmin([loss(t) for t in grid]))
        if 0 < best < 60:
            return float(min(np.geomspace(grid[best - 1], grid[best + 1], 61), key=loss))
        low, high = (low / 100, high) if best == 0 else (low, high * 100)
    return float(grid[best])


def rejection(score: np.ndarray, share: float = REJECTED) -> float:
    """The score below which a share of well-labelled texts falls.

    Fewer than 1 / share scores do not show it: the lower tail of their log-odds is then carried on
    below the least one, as that of an exponential distribution.
    """
    n = len(score)
    if n < 2 or score.max() >= 1 - 1e-15 and score.min() >= 1 - 1e-15:
        return 0.0
    odds = np.log(np.maximum(score, 1e-15)) - np.log(np.maximum(1 - score, 1e-15))
    at = np.quantile(odds, share)
    if n * share < 1:
        at = odds.min() - (np.median(odds) - odds.min()) / np.log(n) * np.log(1 / (n * share))
    return float(1 / (1 + np.exp(-at)))


def fit(labelled: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of `labelled`; `key` is hashed to choose it, and nothing else.

    Languages are counted over all rows. A row is in the sample if its hash falls below its
    language's share; a limit above the expected size keeps it bounded if hashes collide.
    Texts become gram counts on the executors, so no text reaches the driver.
    """
    rows = labelled.select(F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    n = sizes.count()
    if not n:
        return train([], [])
    rows = attach_units(rows, sizes, ["lang"], written=True)
    chosen = F.col("h") < sample_rows * float(1 << 30) / (n * F.col("rows")) + 1

    def one(c):
        both = [counts(t) if has_letter(t) else np.zeros(BUCKETS, np.int64) for t in c["text"]]
        at = [np.flatnonzero(x) for x in both]
        return {"h": c["h"], "lang": c["lang"], "bucket": [i.astype("<u2").tobytes() for i in at], "n": [x[i].astype("<u4").tobytes() for x, i in zip(both, at)]}

    got = by_batch(rows.where(chosen), "h bigint, lang string, bucket binary, n binary", one).limit(2 * sample_rows).collect()
    got = sorted((r for r in got if r.bucket), key=lambda r: (r.h, r.lang, r.bucket, r.n))
    feats = [(np.frombuffer(r.bucket, "<u2").astype(np.int64), np.frombuffer(r.n, "<u4").astype(np.float32)) for r in got]
    return train(feats, [r.lang for r in got])


def held_out(id_col: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))), F.col("doc_id"))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns `keep` of every row with lang_pred, score and rejected (columns of these names are replaced)."""
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(len(keep))]
            lang, score, rejected = zip(*got) if got else ((), (), ())
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *found], names=[*keep, *new])

    return rows.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is not rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not shared.value.predict(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op5_language_id")
def op5_language_id(spark, d):
    docs = table(spark, d, "documents")
    out = identify(docs.select("doc_id", "text"), fit_documents(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
