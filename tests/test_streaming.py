import hashlib

from pyspark.sql import functions as F

from attesta.operators import audit_chain
from attesta.operators import lifecycle as L
from attesta.streaming import state as S


def run(spark, frames, schema, plan, tmp_path, mode="append"):
    """Feed frames as successive files and collect what the query emits."""
    source, name = str(tmp_path / "in"), f"out_{abs(hash(str(tmp_path)))}"
    results = []
    for frame in frames:
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = plan(stream).writeStream.outputMode(mode).foreachBatch(lambda df, _: results.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).queryName(name).start()
        query.awaitTermination()
    return results


def test_leases_survive_batches(spark, tmp_path):
    schema = "issue string, owner string, at double, seq long"
    got = run(spark, [[("i", "a", 0.0, 1), ("i", "b", 5.0, 2), ("j", "z", 1.0, 3)], [("i", "c", 9.9, 4), ("i", "d", 10.0, 5)]], schema, lambda s: S.leases(s, 10), tmp_path)
    assert {(r.owner, r.granted) for r in got} == {("a", True), ("b", False), ("z", True), ("c", False), ("d", True)}


def test_chain_links_and_verifies(spark, tmp_path):
    schema = "chain string, seq long, action string, correlation_id string, fields string"
    frames = [[("a", 2, "read", "c1", '{"x":"é"}'), ("a", 1, "open", "c1", "{}"), ("b", 1, "open", "c2", "{}")], [("a", 3, "close", "c1", '{"n":1}')]]
    got = run(spark, frames, schema, S.audit_chain, tmp_path)
    chain = sorted([r for r in got if r.chain == "a"], key=lambda r: r.seq)
    assert [r.previous_hash for r in chain] == [audit_chain.GENESIS, chain[0].record_hash, chain[1].record_hash]
    body = '{"action":"open","correlation_id":"c1","fields":{},"previous_hash":"GENESIS"}'
    assert chain[0].record_hash == hashlib.sha256(body.encode()).hexdigest()
    stored = spark.createDataFrame(got)
    assert audit_chain.verify(stored, ["chain"]).where("problem is not null").count() == 0
    broken = stored.withColumn("fields", F.when(F.col("seq") == 2, F.lit('{"x":"e"}')).otherwise(F.col("fields"))).where("seq != 1 or chain != 'a'")
    problems = {(r.chain, r.seq): r.problem for r in audit_chain.verify(broken, ["chain"]).where("problem is not null").collect()}
    assert problems == {("a", 2): "digest mismatch"}
    missing = stored.where("chain = 'a' and seq != 2")
    assert {r.seq: r.problem for r in audit_chain.verify(missing, ["chain"]).where("problem is not null").collect()} == {3: "missing predecessor"}


def test_retries_match_the_batch_form(spark, tmp_path):
    schema = "job_id string, seq long, retryable boolean"
    rows = [("j", i, True) for i in range(1, 5)] + [("k", 9, False)]
    got = run(spark, [rows[:2], rows[2:]], schema, S.retries, tmp_path)
    batch = L.attempt_log(spark.createDataFrame(rows, schema), "seq", bucket_rows=2).collect()
    assert {(r.job_id, r.seq, r.attempt, r.outcome) for r in got} == {(r.job_id, r.seq, r.attempt, r.outcome) for r in batch}
    assert {(r.job_id, r.attempt): r.outcome for r in got} == {("j", 1): "retry", ("j", 2): "retry", ("j", 3): "quarantined", ("j", 4): "quarantined", ("k", 1): "quarantined"}


def test_ledger_drops_redelivery(spark, tmp_path):
    schema = "channel string, event_id string, at timestamp"
    from datetime import datetime

    t = datetime(2024, 1, 1)
    got = run(spark, [[("w", "1", t), ("w", "1", t), ("w", "2", t)], [("w", "2", t), ("x", "2", t)]], schema, lambda s: S.deduplicate(s, ["channel", "event_id"], "at", "1 hour"), tmp_path)
    assert sorted((r.channel, r.event_id) for r in got) == [("w", "1"), ("w", "2"), ("x", "2")]


def test_paged_source_reads_to_the_last_page(spark, tmp_path):
    pages = {None: ([(1,), (2,)], "c1"), "c1": ([(3,), (4,)], "c2"), "c2": ([(5,)], None)}
    spark.dataSource.register(S.paged_source("paged_test", "n int", lambda cursor, limit: pages[cursor], 2))
    results = []
    query = spark.readStream.format("paged_test").load().writeStream.foreachBatch(lambda df, _: results.extend(r.n for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(4):
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(results) == [1, 2, 3, 4, 5]


def test_queue_operations(spark):
    queue = spark.createDataFrame([("j1",)], "job_id string")
    incoming = spark.createDataFrame([("j1", 1), ("j2", 3), ("j2", 2)], "job_id string, seq int")
    assert [(r.job_id, r.seq) for r in L.enqueue(queue, incoming, ["seq"]).collect()] == [("j2", 2)]
    states = spark.createDataFrame([("a", "running"), ("b", "failed")], "job_id string, state string")
    assert {r.job_id: r.state for r in L.recover(states).collect()} == {"a": "received", "b": "failed"}
    counts = {r.state: r.n for r in L.state_counts(states.where("state = 'failed'")).collect()}
    assert counts["failed"] == 1 and counts["indexed"] == 0 and len(counts) == 10


def test_reprocess_renames_jobs(spark):
    jobs = spark.createDataFrame([("job_x", "c", "s", "h", "t")], "job_id string, channel string, source_id string, content_hash string, source_type string")
    first, second = L.reprocess(jobs, "2").first(), L.reprocess(jobs, "3").first()
    assert first.job_id != second.job_id and first.state == "received"


def test_health(spark):
    rows = [("a", True), ("a", True), ("b", True), ("b", None), ("c", False)]
    got = L.health(spark.createDataFrame(rows, "service string, ok boolean")).collect()
    assert {r.service: r.state for r in got} == {"a": "ok", "b": "degraded", "c": "failed"}


def test_backoff_retries_transient_errors_only():
    import pytest

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert S.with_backoff(flaky, initial=0.001) == "ok" and len(calls) == 3
    with pytest.raises(TimeoutError):
        S.with_backoff(lambda: (_ for _ in ()).throw(TimeoutError()), attempts=2, initial=0.001)
