"""Pipeline stages: each takes (spark, docs, sf_dir) and returns the documents it keeps.

All but the last keep the columns of `docs`, and no more. Rows that share an id but differ
elsewhere are different documents; decisions are matched to rows by id and a hash of the row.
NULL texts, ids, languages and sources are treated as the operators say; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontaminate, langid, mixing, secrets, simhash
from panelweave.llm.common import row_hash, table



def _fresh(docs: DataFrame, name: str) -> str:
    """`name`, longer if `docs` has it."""
    while name in docs.columns:
        name += "_"
    return name


def _hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    key = _fresh(docs, "__row_hash")
    return docs.withColumn(key, row_hash(docs)), key


def _same(docs: DataFrame, keys: DataFrame, key: str) -> Column:
    return (docs[key] == keys["__h"]) & docs["doc_id"].eqNullSafe(keys["__id"])


def _columns(docs: DataFrame, names: list[str]) -> list[Column]:
    return [docs[f"`{c}`"] for c in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a text without letters goes."""
    return langid.recognised(docs, langid.fit_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest (doc_id, row hash), once; NULL ids come last."""
    found = simhash.near_duplicates(docs, key="h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("k")
    keep = found.groupBy("root").agg(first).select(F.col("k.doc_id").alias("__id"), F.col("k.h").alias("__h"))
    d, key = _hashed(docs)
    kept = d.join(keep, _same(d, keep, key), "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(*_columns(kept, docs.columns))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other parameters."""
    bad = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("row").alias("__h"))
    d, key = _hashed(docs)
    kept = d.join(bad, _same(d, bad, key), "left_anti")
    return kept.select(*_columns(kept, docs.columns))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; `n_chars` is that of the new text where a text changed."""
    old = _fresh(docs, "__old")
    new = secrets.redacted(docs.withColumn(old, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(old))
    chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    new = new.withColumn("n_chars", chars)
    return new.select(*_columns(new, docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted).

    Columns of these names are replaced. Rows equal in every column become one line with the words of all.
    """
    new = ["size", "source_size", "target", "taken"]
    plan = mixing.mix(docs, key="h").where("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(*[F.max(c).alias(c) for c in new[:3]], F.sum("taken").alias("taken"))
    d, key = _hashed(docs)
    d = d.dropDuplicates(["doc_id", key])
    return d.join(plan, _same(d, plan, key)).select(*_columns(d, [c for c in docs.columns if c not in new]), *[plan[c] for c in new])
