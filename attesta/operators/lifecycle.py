"""Queue, ledger, worker and metric state as set operations over append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.ranking import first_per_key, latest_per_key, numbered_within

# Lifecycle states and the retry limit.
LIFECYCLE_STATES = ["received", "validated", "stored", "parsed", "chunked", "embedded", "indexed", "failed", "quarantined", "retry"]
SUCCESS_PATH = ["validated", "stored", "parsed", "chunked", "embedded", "indexed"]
MAX_ATTEMPTS = 3


def enqueue(queue: DataFrame, incoming: DataFrame, order: Sequence[str], key: str = "job_id") -> DataFrame:
    """Jobs to add: the first of each id that the queue has never seen."""
    return first_per_key(incoming.join(queue.select(key), key, "left_anti"), [key], order)


def latest_state(log: DataFrame, order: Sequence[str], key: str = "job_id") -> DataFrame:
    return latest_per_key(log, [key], order)


def state_counts(current: DataFrame, states: Sequence[str] = tuple(LIFECYCLE_STATES), state: str = "state") -> DataFrame:
    """Jobs per lifecycle state, zero-filled for states without jobs."""
    spark: SparkSession = current.sparkSession
    known = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias(state))
    counts = current.groupBy(state).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, state, "left").select(state, F.coalesce("n", F.lit(0)).alias("n"))


def attempt_log(failures: DataFrame, sequence: str, bucket_rows: int = 65_536, key: str = "job_id", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Every failed attempt with its number and what follows: a retry or quarantine.

    ``failures`` has ``retryable``; ``sequence`` is an integer event order. Numbering is
    bucketed, so a job that fails endlessly does not end up in one task.
    """
    numbered = numbered_within(failures, [key], [sequence], F.expr(f"`{sequence}` div {int(bucket_rows)}"), "attempt")
    again = F.col("retryable") & (F.col("attempt") < max_attempts)
    return numbered.withColumn("outcome", F.when(again, F.lit("retry")).otherwise(F.lit("quarantined")))


def retry_dead_letters(dead: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """The oldest dead letters, moved back to retry."""
    return dead.orderBy(*order).limit(max(0, limit)).withColumn("state", F.lit("retry"))


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash, work in progress is pending again."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", F.lit("received")).otherwise(F.col("state")))


def reprocess(jobs: DataFrame, parser_version: str) -> DataFrame:
    """New jobs for stored bytes under another parser version."""
    from attesta.functions import ids

    version = F.lit(parser_version)
    renamed = ids.job_id(F.col("channel"), F.col("source_id"), F.col("content_hash"), F.col("source_type"), version)
    return jobs.withColumns({"job_id": renamed, "parser_version": version, "state": F.lit("received"), "attempts": F.lit(0)})


def ledger_first(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First event per ledger key; later deliveries are duplicates."""
    return first_per_key(events, keys, order)


def unseen(events: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.join(ledger.select(*keys), list(keys), "left_anti")


def next_claims(jobs: DataFrame, now: Column, queue: str, created: str = "created_at", expires: str = "expires_at") -> DataFrame:
    """Oldest unexpired pending job per queue."""
    pending = jobs.where((F.col("status") == "pending") & (F.col(expires) > now))
    return first_per_key(pending, [queue], [created, "job_id"])


def expire(jobs: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    overdue = (F.col("status") == "pending") & (F.col(expires) <= now)
    return jobs.withColumn("status", F.when(overdue, F.lit("expired")).otherwise(F.col("status")))


def completion_verdict(job: str = "status") -> Column:
    """Outcome of a completion message joined to its job: accepted or why it is refused.

    Needs ``status, lease_token, lease_expires_at`` of the job and ``given_token, submitted_at``.
    """
    return (
        F.when(F.col(job).isNull(), F.lit("unknown job"))
        .when(F.col(job) == "completed", F.lit("replayed"))
        .when(F.col(job) != "leased", F.lit("not leased"))
        .when(F.col("lease_token") != F.col("given_token"), F.lit("token mismatch"))
        .when(F.col("lease_expires_at") < F.col("submitted_at"), F.lit("lease expired"))
        .otherwise(F.lit("accepted"))
    )


def heartbeats(beats: DataFrame, order: Sequence[str], worker: str = "worker_id") -> DataFrame:
    return latest_per_key(beats, [worker], order)


def health(checks: DataFrame, service: str = "service", ok: str = "ok") -> DataFrame:
    """ok when every dependency is, degraded when some are, failed when none is."""
    rolled = checks.groupBy(service).agg(F.bool_and(F.coalesce(F.col(ok), F.lit(False))).alias("_all"), F.bool_or(F.coalesce(F.col(ok), F.lit(False))).alias("_any"))
    return rolled.select(service, F.when(F.col("_all"), F.lit("ok")).when(F.col("_any"), F.lit("degraded")).otherwise(F.lit("failed")).alias("state"))


def metrics(samples: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Counters and observation statistics per metric, in name order."""
    return samples.groupBy(name).agg(F.count(F.lit(1)).alias("counter"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest")).orderBy(name)
