"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters. (Fixed values.)
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_hash(df: DataFrame, cols: list[str] | None = None) -> Column:
    """A hash of all columns (NULL-aware), telling rows with equal ids apart."""
    cols = cols or df.columns
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols], *[F.col(f"`{c}`").isNull() for c in cols])


def by_batch(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]], rows: int = 256) -> DataFrame:
    """Map rows in small Arrow batches: `fn` takes and returns columns as Python lists."""
    from pyspark.sql.types import StructType

    target = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _arrow(name: str) -> pa.DataType:
    return pa.list_(_arrow(name[6:-1])) if name.startswith("array<") else _TYPES[name]
