"""Helpers shared by the operators: table access, saved intermediates, Arrow columns, expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import prepare, shared_checkpoint_dir

#: Rows handed to Python at a time; texts may be long, so batches stay small.
BATCH_ROWS = 1000
BATCH_BYTES = 64 * 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the folder all executors share, and read it back."""
    spark = df.sparkSession
    path = f"{shared_checkpoint_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` needs it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(key: Column) -> Column:
    """Rows whose crc32(key as text) mod 4 is 2; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def trainable(key: Column) -> Column:
    """Rows that may be learned from: a known key that is not held out."""
    return key.isNotNull() & ~held_out(key)


def hash_below(key: Column, fraction: float) -> Column:
    """A deterministic share of the rows, chosen by the hash of their key."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(fraction * 1_000_000)


def with_arrow_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """Append columns that ``make()(batch)`` computes; ``keep`` names the input columns that stay.

    An input column named like an appended one is replaced (names differ by more than case).
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(columns + compute(batch), names=names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py()
