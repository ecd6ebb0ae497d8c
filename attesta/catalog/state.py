"""Queue, ledger, worker and metric state."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.operators import audit_chain
from attesta.operators import lifecycle as L
from attesta.sources import corpus

_STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'received' WHEN 'view' THEN 'parsed' WHEN 'click' THEN 'chunked' ELSE 'indexed' END"


def _events(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events")


def _log(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.expr(_STATE).alias("state"), "ts", "event_id")


@query("queue_enqueue", "SELECT user_id AS job_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id")
def queue_enqueue(spark, sf_dir):
    """Jobs seen for the first time; customers of one segment are queued already."""
    queued = corpus.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    incoming = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "event_id")
    return L.enqueue(queued, incoming, ["event_id"])


@query("latest_state", f"SELECT user_id AS job_id, arg_max({_STATE}, event_id) AS state, max(ts) AS ts FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return L.latest_state(_log(spark, sf_dir), ["ts", "event_id"]).select("job_id", "state", "ts")


@query(
    "queue_state_counts",
    f"""WITH cur AS (SELECT user_id, arg_max({_STATE}, event_id) AS state FROM events GROUP BY user_id), s AS (SELECT unnest({L.LIFECYCLE_STATES}) AS state)
 SELECT s.state, count(cur.user_id) AS n FROM s LEFT JOIN cur ON cur.state = s.state GROUP BY s.state""",
)
def queue_state_counts(spark, sf_dir):
    return L.state_counts(L.latest_state(_log(spark, sf_dir), ["ts", "event_id"]))


@query(
    "dlq_attempts",
    """SELECT user_id AS job_id, event_id, attempt, CASE WHEN retryable AND attempt < 3 THEN 'retry' ELSE 'quarantined' END AS outcome FROM (
 SELECT user_id, event_id, value < 40 AS retryable, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events WHERE event_type = 'error')""",
)
def dlq_attempts(spark, sf_dir):
    failures = _events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("job_id"), "event_id", (F.col("value") < 40).alias("retryable"))
    return L.attempt_log(failures, "event_id").select("job_id", "event_id", "attempt", "outcome")


@query(
    "dlq_retry",
    "SELECT user_id AS job_id, event_id, 'retry' AS state FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 10",
)
def dlq_retry(spark, sf_dir):
    dead = _events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("job_id"), "event_id", "ts")
    return L.retry_dead_letters(dead, 10, ["ts", "event_id"]).select("job_id", "event_id", "state")


@query("ledger_first_event", "SELECT event_type AS channel, user_id AS event_id, min(event_id) AS seq, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def ledger_first_event(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.col("event_type").alias("channel"), F.col("user_id").alias("event_id"), F.col("event_id").alias("seq"), "value")
    return L.ledger_first(events, ["channel", "event_id"], ["seq"])


@query("ledger_unseen", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.event_id AND o.o_orderstatus = 'F')")
def ledger_unseen(spark, sf_dir):
    """Deliveries not in the ledger; fulfilled orders stand for recorded events."""
    ledger = corpus.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return L.unseen(_events(spark, sf_dir).select("event_id"), ledger, ["event_id"])


@query("heartbeat_latest", "SELECT user_id AS worker_id, arg_max(event_type, event_id) AS status, max(event_id) AS beat FROM events GROUP BY user_id")
def heartbeat_latest(spark, sf_dir):
    beats = _events(spark, sf_dir).select(F.col("user_id").alias("worker_id"), F.col("event_type").alias("status"), F.col("event_id").alias("beat"))
    return L.heartbeats(beats, ["beat"])


@query("health_rollup", "SELECT user_id AS service, CASE WHEN bool_and(value < 150) THEN 'ok' WHEN bool_or(value < 150) THEN 'degraded' ELSE 'failed' END AS state FROM events GROUP BY user_id")
def health_rollup(spark, sf_dir):
    return L.health(_events(spark, sf_dir).select(F.col("user_id").alias("service"), (F.col("value") < 150).alias("ok")))


@query("metrics_snapshot", "SELECT event_type AS name, count(*) AS counter, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, min(json_extract_string(props, '$.k')::BIGINT) AS lowest, max(json_extract_string(props, '$.k')::BIGINT) AS highest FROM events GROUP BY 1")
def metrics_snapshot(spark, sf_dir):
    samples = _events(spark, sf_dir).select(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("value"))
    return L.metrics(samples)


@query(
    "claim_next",
    """SELECT o_orderpriority AS queue, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS job_id FROM orders
 WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1995-01-01 00:00:00' GROUP BY 1""",
)
def claim_next(spark, sf_dir):
    jobs = corpus.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", F.lit("pending")).otherwise(F.lit("done")).alias("status"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
    )
    return L.next_claims(jobs, F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'"), "queue").select("queue", "job_id")


@query(
    "expire_jobs",
    "SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-06-01 00:00:00' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status, count(*) AS n FROM orders GROUP BY 1",
)
def expire_jobs(spark, sf_dir):
    jobs = corpus.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "O", F.lit("pending")).otherwise(F.lit("done")).alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at")
    )
    return L.expire(jobs, F.expr("TIMESTAMP_NTZ'1996-06-01 00:00:00'")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "completion_verdicts",
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'unknown job' WHEN o_orderstatus = 'F' THEN 'replayed' WHEN o_orderstatus <> 'O' THEN 'not leased' WHEN l_returnflag <> 'N' THEN 'token mismatch'
   WHEN o_orderdate + INTERVAL 60 DAY < l_shipdate THEN 'lease expired' ELSE 'accepted' END AS verdict FROM lineitem LEFT JOIN orders o ON o.o_orderkey = l_orderkey) GROUP BY 1""",
)
def completion_verdicts(spark, sf_dir):
    """Line items as completion messages for their orders' leases."""
    messages = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("given_token"), F.col("l_shipdate").alias("submitted_at"))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "O", F.lit("leased")).otherwise(F.lit("pending"))
    jobs = corpus.table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.lit("N").alias("lease_token"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("lease_expires_at"))
    joined = messages.join(jobs, messages.l_orderkey == jobs.o_orderkey, "left")
    return joined.select(L.completion_verdict().alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "canonical_record_hash",
    """SELECT event_id, sha256('{"action":"' || event_type || '","correlation_id":"corr-' || user_id || '","fields":{"k":' || json_extract_string(props, '$.k') || ',"user":"u-' || user_id || '"},"previous_hash":"GENESIS"}') AS record_hash FROM events""",
)
def canonical_record_hash(spark, sf_dir):
    fields = audit_chain.canonical_json({"user": audit_chain.json_string(corpus.text_of("u-", F.col("user_id"))), "k": F.get_json_object("props", "$.k")})
    digest = audit_chain.record_hash(F.col("event_type"), corpus.text_of("corr-", F.col("user_id")), fields, F.lit(audit_chain.GENESIS))
    return _events(spark, sf_dir).select("event_id", digest.alias("record_hash"))


@query(
    "admin_retire_guard",
    "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'legal hold' ELSE 'retired' END AS outcome FROM labels",
)
def admin_retire_guard(spark, sf_dir):
    """Good documents are under legal hold; the others may be retired."""
    from attesta.plans import admin

    labels = corpus.table(spark, sf_dir, "labels")
    hold = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("true")).otherwise(F.lit("false"))
    sources = labels.select("doc_id", F.map_from_arrays(F.array(F.lit("legal_hold")), F.array(hold)).alias("metadata"))
    return sources.select("doc_id", F.when(admin.under_legal_hold(), F.lit("legal hold")).otherwise(F.lit("retired")).alias("outcome"))


@query(
    "model_route_table",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN CASE WHEN local_safe THEN 'local' ELSE 'refused' END WHEN 2 THEN CASE WHEN local_safe THEN 'local' ELSE 'remote' END ELSE CASE WHEN local_safe THEN 'local' ELSE 'remote' END END AS provider
 FROM (SELECT *, value <= 100 AND json_extract_string(props, '$.k')::BIGINT <= 60 AND event_type <> 'error' AS local_safe FROM events)""",
)
def model_route_table(spark, sf_dir):
    from attesta.plans import router

    events = _events(spark, sf_dir)
    policy = corpus._choice(F.col("event_id"), ["remote_required", "local_only", "local_preferred", "remote_allowed"])
    choice = router.route_provider(policy, F.col("event_type") != "error", F.lit(False), F.col("value") * 10, F.get_json_object("props", "$.k").cast("long"), F.lit(0), F.lit(0), router.RouteLimits(1000, 60, 4, 4))
    return events.select("event_id", choice.alias("provider"))
