"""Replay of spooled events: files left while the receiver was away, delivered once each.

A spool is a folder of files that only grows. Replay is a stream that takes what is there and
ends. Each micro-batch overwrites one folder of its own, so a batch that broke off between the write
and the commit is written again over itself. Events that were spooled more than once are told by
their key when the delivered rows are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attesta.operators.lifecycle import ledger_first

Sink = Callable[[DataFrame, str, int], None]


def write_batch(rows: DataFrame, target: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{target}/batch={number}")


def replay_spool(spark: SparkSession, spool: str, target: str, checkpoint: str, schema: T.StructType, files_a_batch: int = 64, sink: Sink = write_batch) -> None:
    """Deliver every file of ``spool`` that the checkpoint does not know as delivered; returns when done.

    An error of the sink ends the replay; another call with the same checkpoint goes on with the
    batch that broke off.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(spool)
    writer = stream.writeStream.foreachBatch(lambda rows, number: sink(rows, target, number))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def delivered(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Delivered events, the first of each key by ``order``."""
    rows = spark.read.schema(schema).parquet(target).select(*schema.names)
    return ledger_first(rows, keys, order)
