"""Mixing sources to target weights by fitting word budgets exactly.

1. Targets. Sources share a budget by weight. A target stops at `CAP` times its source's size
   and the excess goes to the others by weight, until no target is above its cap.
2. Counts. A source's documents are counted by exact length; only these counts are fitted.
3. Budget. All documents are taken `floor(target / size of the source)` times. What remains is
   filled with further copies: of every length the same share first, then the rest by a
   bounded-knapsack dynamic programme (which sums can be reached, one bit a sum) over the
   copies left, in the smallest window of the budget that leaves room for choice.
4. Selection. Of each length the documents with the smallest seeded hash of their id are taken,
   as many as fitted, numbered by a scan over ranges so that no group has to fit in one task.

Defined cases: NULL or wordless text has size 0 and is taken 0 words; NULL is a source like any
other and comes last; an empty table gives no rows; rows with one id are separate documents
(which of two rows equal in id, source and size is taken again does not show); NULL ids are
hashed like a value. Columns other than id, text and source are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, query, row_hash, table
from panelweave.operators.prefix import null_safe_join, spread_scan
from panelweave.session import cut_lineage

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all words
CAP = 2  # times a source's size
SEED = 20240
REACH = 1 << 15  # words: largest budget the programme resolves word by word


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), one for each source.

    Each round is one sum over the sources; sources at their cap stay there, so rounds end.
    """
    order = [F.col("source").asc_nulls_last()]
    s = spread_scan(sizes, [], order, {"rank": ("sum", F.lit(1), "before")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.coalesce("rank", F.lit(0)) % len(weights) + 1).cast("int"))
    s = cut_lineage(s.select("source", "source_size", weight.alias("w")))
    most = F.lit(float(cap)) * F.col("source_size")
    budget = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words for each unit of weight
    while True:
        at_cap = F.col("w") * level >= most
        capped, free, n = s.agg(F.sum(F.when(at_cap, most)), F.sum(F.when(~at_cap, F.col("w"))), F.count(F.when(~at_cap, 1))).first()
        if not n:
            break
        up = (budget - (capped or 0.0)) / free
        if up <= level:
            break
        level = up
    return s.select("source", "source_size", F.least(most, F.col("w") * level).alias("target"))


def fit_counts(lengths: np.ndarray, have: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many of `have[i]` items of length `lengths[i]` to take so that their sum is as near to
    `budget` from below as the window of the programme shows."""
    lengths, have = lengths.astype(np.int64), have.astype(np.int64)
    total = int((lengths * have).sum())
    if budget >= total:
        return have.copy()
    if budget <= 0:
        return np.zeros_like(have)
    take = np.array([h * budget // total for h in have.tolist()], np.int64)  # exact in Python's integers
    rest = budget - int((lengths * take).sum())
    # a copy at a time, longest first, while more is left than the programme resolves
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= reach:
            break
        n = min(int(have[i] - take[i]), (rest - reach) // max(1, int(lengths[i])) + 1, rest // max(1, int(lengths[i])))
        take[i] += n
        rest -= int(n * lengths[i])
    # put some copies back, so that the programme has sums to choose from
    for i in np.argsort(lengths, kind="stable"):
        if rest >= reach // 2:
            break
        if lengths[i] > 0 and take[i] > 0:
            n = min(int(take[i]), (reach - rest) // int(lengths[i]), 8)
            take[i] -= n
            rest += int(n * lengths[i])
    # bit s of `sums`: s words can be reached; copies of a length go in powers of two
    steps, sums, mask = [], 1, (1 << (rest + 1)) - 1
    for i in np.argsort(-lengths, kind="stable"):
        left, size, part = int(have[i] - take[i]), int(lengths[i]), 1
        if size == 0 or size > rest:
            continue
        left = min(left, rest // size)
        while left > 0 and not sums >> rest & 1:
            n = min(part, left)
            steps.append((i, n, sums))
            sums |= (sums << (n * size)) & mask
            left, part = left - n, part * 2
        if sums >> rest & 1:
            break
    best = sums.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> best & 1:
            take[i] += n
            best -= int(n * lengths[i])
    return take


def fit_budgets(histogram: DataFrame) -> DataFrame:
    """Per (source, size): `whole` copies of each document and `extra` documents to take once more.

    `histogram` has rows (source, size, n, source_size, target). One task holds the lengths of one
    source, which grow with the longest document, not with the number of documents.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        target, size = float(pdf.target.iloc[0]), int(pdf.source_size.iloc[0])
        whole = min(CAP, math.floor(target / size)) if size else 0
        pdf = pdf.sort_values("size", ignore_index=True)
        extra = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target - whole * size)) if whole < CAP else 0
        return pdf.assign(whole=whole, extra=extra)[["source", "size", "source_size", "target", "whole", "extra"]]

    schema = f"source {histogram.schema['source'].dataType.simpleString()}, size long, source_size long, target double, whole long, extra long"
    return histogram.groupBy("source").applyInPandas(one, schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: str | None = None, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row; `key` adds a hash of all columns."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        *([row_hash(docs).alias(key)] if key else []),
        F.col(f"`{source_col}`").alias("source"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
    )
    rows = cut_lineage(rows.withColumn("__draw", F.xxhash64(F.lit(seed), "doc_id", *([key] if key else []))))
    hist = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = cut_lineage(fit_budgets(null_safe_join(hist, targets, ["source"])))
    order = [F.col("__draw"), F.col("doc_id")]
    ranked = spread_scan(rows, ["source", "size"], order, {"__rank": ("sum", F.lit(1), "upto")})
    out = null_safe_join(ranked, plan, ["source", "size"], plain=("size",))
    taken = F.col("size") * (F.col("whole") + (F.col("__rank") <= F.col("extra")).cast("long"))
    return out.select("doc_id", *([key] if key else []), "size", "source_size", "target", taken.alias("taken"))


@query("op9_mix_to_targets")
def op9_mix_to_targets(spark, d):
    return mix(table(spark, d, "documents"))
