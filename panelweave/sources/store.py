"""Resumable and labelled result stores on plain Parquet folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def run_missing(spark: SparkSession, path: str, wanted: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute only the keys of `wanted` that are not stored yet and return the whole store.

    The store is partitioned by key and written with dynamic partition overwrite, so a job
    that died half way is simply run again. A key counts as done once its partition holds rows.
    """
    todo = wanted.select(key).distinct()
    if _exists(spark, path):
        done = spark.read.parquet(path).select(F.col(key).cast(wanted.schema[key].dataType).alias(key)).distinct()
        todo = todo.join(done, key, "left_anti")
    if not todo.isEmpty():
        (
            make(todo)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(key)
            .parquet(path)
        )
    return spark.read.parquet(path)


def save_result(df: DataFrame, path: str, label: str) -> None:
    """Store one labelled result; the same label is replaced, others stay."""
    (
        df.withColumn("label", F.lit(label))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("label")
        .parquet(path)
    )


def load_results(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("label").isin(labels)) if labels else df


def apply_decisions(df: DataFrame, decisions: DataFrame, keys: list[str], drop_comment: str = "drop") -> DataFrame:
    """Bring reviewed rows back: renamed countries replace the old ones, dropped rows go.

    `decisions` holds the keys, an optional `new_country` and a `comment`.
    """
    d = decisions.select(*keys, F.col("new_country"), F.col("comment"))
    j = df.join(d, keys, "left")
    kept = j.where(F.coalesce(F.col("comment") != drop_comment, F.lit(True)))
    return kept.withColumn("country", F.coalesce(F.col("new_country"), F.col("country"))).drop("new_country", "comment")
