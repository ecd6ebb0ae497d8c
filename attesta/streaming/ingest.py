"""Watched folders into the evidence store.

Polling compares a metadata-only listing with the table of observed files, so a modified file
(new size or time) is taken again; the streaming source delivers each path once. Both
end in :func:`process_batch`, whose writes are keyed by batch and therefore replayable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import lifecycle
from attesta.operators.store import EvidenceStore
from attesta.plans.ingest import ingest
from attesta.session import cut_lineage
from attesta.sources import files as S

OBSERVED_KEYS = ["source_uri", "size_bytes", "modified_at"]


def process_batch(store: EvidenceStore, found: DataFrame, channel: str, batch: str, space: str = "hash-768:768:v1", **scope: str) -> DataFrame:
    """Expand, classify, parse and ingest files; returns the lifecycle rows that were logged.

    Jobs already known are skipped. Files that cannot be parsed are quarantined with the
    reason: the failure is in the bytes, so another attempt would fail the same way.
    """
    parsed = cut_lineage(S.parse_jobs(S.ingestion_jobs(found, channel)))
    seen = store.read("jobs").where(F.col("batch") != batch)
    fresh = lifecycle.enqueue(seen.select("job_id"), parsed, ["source_uri"])
    good = fresh.where(F.col("error").isNull())
    raw = good.select(
        "source_id", "source_uri", "content", "channel", "mime_type", "source_type", "source_kind", F.concat("source_type", F.lit("-parser")).alias("parser_name"),
        F.col("blocks").alias("_blocks"), *[F.lit(v).alias(k) for k, v in scope.items()],
    )
    ingest(store, raw, batch, space, blocks=F.col("_blocks"))
    log = lifecycle_rows(fresh)
    store.append("lifecycle", log, batch)
    store.append("jobs", fresh.drop("content", "blocks"), batch)  # last: a batch that broke off is taken again
    return log


def lifecycle_rows(jobs: DataFrame) -> DataFrame:
    """Milestones of processed jobs: the success path, or failed and quarantined."""
    path = lambda names: F.array(*[F.lit(n) for n in names])
    states = F.when(F.col("error").isNull(), path(["received", *lifecycle.SUCCESS_PATH])).otherwise(path(["received", "failed", "quarantined"]))
    rows = jobs.select("job_id", "error", F.posexplode(states).alias("position", "state"))
    details = F.when(F.col("error").isNotNull(), F.create_map(F.lit("reason"), F.col("error"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("job_id", "state", (F.current_timestamp() + F.make_dt_interval(secs=F.col("position") / 1000)).alias("at"), F.lit(1).alias("attempt"), details.alias("details"))


def watch(store: EvidenceStore, path: str, checkpoint: str, channel: str = "directory", glob: str | None = None, available_now: bool = True, **scope: str) -> StreamingQuery:
    """Stream a folder into the store, exactly once per file."""
    stream = S.stream_files(store.spark, path, glob)

    def sink(batch_df: DataFrame, batch_id: int) -> None:
        process_batch(store, batch_df, channel, f"{channel}-{batch_id}", **scope)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def changed_files(listing: DataFrame, observed: DataFrame) -> DataFrame:
    """Files that are new or differ in size or modification time from every observation."""
    return listing.join(observed.select(*OBSERVED_KEYS), OBSERVED_KEYS, "left_anti")


def poll(store: EvidenceStore, path: str, observed: DataFrame, batch: str, channel: str = "directory", glob: str | None = None, **scope: str) -> DataFrame:
    """One polling round; returns the observations to remember.

    The comparison reads file metadata only; content is loaded for the files that changed.
    """
    scanned = S.scan_files(store.spark, path, glob)
    changed = cut_lineage(changed_files(scanned.select(*OBSERVED_KEYS), observed))
    process_batch(store, scanned.join(changed, OBSERVED_KEYS, "left_semi"), channel, batch, **scope)
    return observed.select(*OBSERVED_KEYS).unionByName(changed)


def remote_files(spark: SparkSession, paths: Iterable[str], observed: DataFrame, read_file: Callable[[str], bytes], scheme: str = "sftp") -> DataFrame:
    """Files behind an injected reader, each path once, fetched inside the tasks."""
    listed = spark.createDataFrame([(f"{scheme}://{p}", p) for p in sorted(paths)], "source_uri string, remote_path string")
    fresh = listed.join(observed.select("source_uri"), "source_uri", "left_anti")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_uri", pa.string()), ("content", pa.binary()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", tz="UTC"))])
        for batch in batches:
            for row in batch.to_pylist():
                data = read_file(row["remote_path"])
                yield pa.RecordBatch.from_pylist([{"source_uri": row["source_uri"], "content": data, "size_bytes": len(data), "modified_at": None}], schema=schema)

    return fresh.mapInArrow(fetch, "source_uri string, content binary, size_bytes long, modified_at timestamp")
