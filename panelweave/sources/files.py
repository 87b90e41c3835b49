"""CSV and Parquet readers and writers with the conventions of the inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.tables import natural_left_join


def read_csv(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """Header CSV with `NA` as missing; columns are matched to the schema by position in the file.

    A leading unnamed row-number column is given in the schema as `_c0` and dropped.
    """
    df = spark.read.schema(schema).option("header", True).option("nullValue", "NA").option("enforceSchema", True).csv(path)
    return df.drop("_c0")


def read_keyed_csv(spark: SparkSession, path, schema, pattern: str, key: str, key_type: str = "int") -> DataFrame:
    """Many files with one schema; `key` is the first group of `pattern` in each file path."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast(key_type))


def stitch(frames: list[DataFrame], drop: list[str] = ()) -> DataFrame:
    """Column-partitioned extracts back to one wide table, joined on their shared names."""
    return reduce(natural_left_join, [f.drop(*drop) for f in frames])


def read_levels(spark: SparkSession, path: str, levels: list[int], parts: list[str] | None = None) -> DataFrame:
    """Only the needed (level, part) folders of a partitioned layer; vanished files are skipped."""
    df = spark.read.option("ignoreMissingFiles", True).parquet(path).where(F.col("level").isin(list(levels)))
    return df.where(F.col("part").isin(list(parts))) if parts else df


def curve_columns(df: DataFrame, key: str, country: str, prefix: str = "p") -> DataFrame:
    """Wide `p0..p100` columns to `curve: array<struct<p, v>>` under standard key names."""
    ps = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()), key=lambda c: int(c[len(prefix):]))
    curve = F.array(*[F.struct(F.lit(float(c[len(prefix):])).alias("p"), F.col(c).cast("double").alias("v")) for c in ps])
    return df.select(F.col(key).alias("unit_id"), F.col(country).alias("country"), curve.alias("curve"))


EDGE_SCHEMA = T.StructType(
    [
        T.StructField("geom_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("x2", T.DoubleType()),
        T.StructField("y2", T.DoubleType()),
    ]
)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Vector layer kept as an edge table."""
    return spark.read.schema(EDGE_SCHEMA).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def column_listing(df: DataFrame) -> DataFrame:
    """One row per column of `df`."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, variable string, type string")
