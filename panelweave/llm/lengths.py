"""Token counts as an exact length histogram.

Every whole text is encoded once; documents are counted by their number of tokens. Suffix sums
over the lengths then answer, for every context limit at once and without the texts: how many
documents reach the limit, how many tokens they hold, how many tokens remain if every text is
cut there, and which length stands at any quantile.

The histogram has as many rows as there are distinct lengths. Its sums run over blocks of
`BLOCK` lengths first and over the blocks' totals then, so no task needs all lengths.

Defined cases: NULL and empty text have length 0 and are counted; repeated rows count each; an
empty table gives no rows; columns other than the text are ignored. Long texts are cut for the
encoder where a run of white space starts, a place where its own splitting rule always cuts, so
the tokens stay the same; a single piece beyond `PIECE` without white space is encoded as it is.
"""

from __future__ import annotations

import base64
import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.llm.common import by_batch, query, table
from panelweave.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Splitting rule of the tokenizer. (Fixed value.)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 17  # characters
BLOCK = 1024  # lengths

_CUT = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(2)
def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Cut `text` into parts of about `size` characters where tokens cannot cross."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def n_tokens(text: str | None, path: str = TOKENIZER) -> int:
    if not text:
        return 0
    e = encoder(path)
    return sum(len(e.encode_ordinary(p)) for p in pieces(text.encode("utf-8", "replace").decode()))


def token_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str = TOKENIZER) -> DataFrame:
    """`n_tokens` of every row, after the long columns `keep`."""
    keep = keep or []
    rows = docs.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in keep], F.col(f"`{text_col}`").alias("__text"))
    one = lambda c: {**{k: c[k] for k in keep}, "n_tokens": [n_tokens(t, path) for t in c["__text"]]}
    return by_batch(rows, ", ".join(f"`{k}` bigint" for k in [*keep, "n_tokens"]), one)


def length_histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Per distinct length: n_docs, and over it and all longer ones docs_from, tokens_from; over it
    and all shorter ones docs_upto; truncated_total, the tokens left if texts are cut at this length."""
    n = cut_lineage(counts.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")))
    n = n.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("__tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = n.groupBy("__block").agg(F.sum("n_docs").alias("d"), F.sum("__tokens").alias("t"))
    across = W.orderBy("__block")  # a row for each 1024 lengths
    before, after = across.rowsBetween(W.unboundedPreceding, -1), across.rowsBetween(1, W.unboundedFollowing)
    sums = {"__d0": F.sum("d").over(before), "__t0": F.sum("t").over(before), "__d1": F.sum("d").over(after), "__t1": F.sum("t").over(after)}
    carry = totals.select("__block", *[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()])
    inside = W.partitionBy("__block").orderBy("n_tokens")
    upto, on = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(0, W.unboundedFollowing)
    return (
        n.withColumns({"__du": F.sum("n_docs").over(upto), "__tb": F.sum("__tokens").over(upto) - F.col("__tokens"), "__df": F.sum("n_docs").over(on), "__tf": F.sum("__tokens").over(on)})
        .join(carry, "__block")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("__du") + F.col("__d0")).alias("docs_upto"),
            (F.col("__df") + F.col("__d1")).alias("docs_from"),
            (F.col("__tf") + F.col("__t1")).alias("tokens_from"),
            (F.col("__tb") + F.col("__t0") + F.col("n_tokens") * (F.col("__df") + F.col("__d1"))).alias("truncated_total"),
        )
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """Per row of `limits` (context): docs_over and tokens_over (beyond the limit), truncated_total.

    Everything follows from the first histogram row above the limit: an as-of lookup, done by
    sorting limits and lengths together.
    """
    h = histogram.select(F.col("n_tokens").alias("at"), F.lit(1).alias("kind"), "docs_from", "tokens_from", "n_docs")
    asked = limits.select(F.col("context").cast("long").alias("at"), F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("docs_from", "tokens_from", "n_docs")])
    total = histogram.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("t"))
    # the block number keeps each sort small; a limit looks into the next nonempty block if its own has none
    above = W.partitionBy("block").orderBy(F.col("at").asc(), F.col("kind").desc()).rowsBetween(1, W.unboundedFollowing)
    both = h.unionByName(asked).withColumn("block", F.floor(F.col("at") / BLOCK))
    first = lambda c: F.first(F.when(F.col("kind") == 1, F.struct("docs_from", "tokens_from")), True).over(c)
    firsts = both.groupBy("block").agg(F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("kind") == 1, F.col("at"))).alias("f"))
    later = W.orderBy("block").rowsBetween(1, W.unboundedFollowing)
    nxt = firsts.select("block", F.first("f", True).over(later).alias("later"))
    got = both.withColumn("f", first(above)).where("kind = 0").join(nxt, "block").withColumn("f", F.coalesce("f", "later"))
    docs, tokens = F.coalesce("f.docs_from", F.lit(0)), F.coalesce("f.tokens_from", F.lit(0))
    over = tokens - docs * F.col("at")
    return got.withColumn("total", total.scalar()).select(F.col("at").alias("context"), docs.alias("docs_over"), over.alias("tokens_over"), (F.col("total") - over).alias("truncated_total"))


def at_quantiles(histogram: DataFrame, probs: list[float]) -> DataFrame:
    """(p, n_tokens): the smallest length that at least a share p of the documents does not exceed."""
    n = histogram.agg(F.max("docs_upto").alias("n"))
    need: list[Column] = [F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))) for p in probs]
    h = histogram.withColumn("n", n.scalar())
    row = h.agg(*[F.min(F.when(F.col("docs_upto") >= k, F.col("n_tokens"))).alias(f"q{i}") for i, k in enumerate(need)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("n_tokens")) for i, p in enumerate(probs)])).alias("x")).select("x.*")


@query("op6_token_length_histogram")
def op6_token_length_histogram(spark, d):
    return length_histogram(token_counts(table(spark, d, "documents")))
