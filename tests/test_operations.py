"""Requests in both forms, schema migration with data, spool replay."""

import pytest
from pyspark.errors import StreamingQueryException

from attesta.operators.migration import Drift, Step, VersionedTable
from attesta.plans import requests as R
from attesta.plans.audit import AuditRequest
from attesta.streaming import spool


def parsed(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, request string")
    return [r.parsed for r in R.parse_requests(rows).orderBy("i").collect()]


def test_mapping_fields_by_every_key(spark):
    a, b, c = parsed(
        spark,
        '{"request": "why", "systems": [" a ", "", null, 3], "issues": "x; y,\\nz", "to": "2024-05-01T10:00:00+0200", "live_verification_required": 1, "more": {"k": [1]}}',
        '{"query": "", "scope": "all", "components": 7, "systems": [], "from": "no time", "require_live_verification": false}',
        "{}",
    )
    assert (a.form, a.query, a.systems, a.symptoms, a.live_verification, a.unknown) == ("mapping", "why", [" a ", "3"], ["x", "y", "z"], True, {"more": '{"k":[1]}'})
    assert a.until.isoformat() == "2024-05-01T08:00:00" and a.since is None
    assert (b.query, b.scope, b.components, b.systems, b.since, b.live_verification) == ("all", "all", ["7"], [], None, False)
    assert (c.form, c.query, c.unknown) == ("mapping", "", {})


def test_text_form_agrees_with_the_request_of_one(spark):
    texts = [
        "  audit scope: billing\nsystem: erp, crm ; \ncomponent: api\nfailure: timeout in log; request_id=r-1 trace-id: t.2 live verification ",
        "about: nothing else", "[1, 2]", '"quoted"', "query output and splunk-csv of the db", "systems:", "", '{"query": broken',
    ]
    for got, text in zip(parsed(spark, *texts), texts):
        one = AuditRequest.parse(text)
        assert got.form == "text"
        assert (got.query, got.scope.strip(), got.live_verification) == (one.query, one.scope.strip(), one.live_verification)
        for name in ("systems", "components", "symptoms", "source_types", "correlation_ids"):
            assert tuple(getattr(got, name)) == tuple(getattr(one, name)), (name, text)


def test_null_request_and_search_terms(spark):
    assert parsed(spark, None) == [None]
    rows = spark.createDataFrame([('{"query": "why", "systems": "a,b"}',), ("{}",)], "request string")
    assert [r[0] for r in R.parse_requests(rows).select(R.search_terms(R.F.col("parsed"))).collect()] == ["why a b", "failure audit"]


STEPS = [Step(2, "upper", {"name": "upper(name)"}), Step(3, "size", {"size": "length(name)"}, ("id",))]


def test_rows_move_through_the_versions_once(spark, tmp_path):
    root = f"{tmp_path}/t"
    table = VersionedTable(spark, root, STEPS)
    table.create(spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, name string"))
    STEPS[0].apply(table.read(1)).limit(1).write.parquet(f"{root}/v=2")  # broke off before its ledger row
    assert table.migrate() == [2, 3] and table.migrate() == []
    assert sorted(map(tuple, table.read().collect()), key=str) == [("A", 1), (None, None), (None, None)]
    assert table.read(1).columns == ["id", "name"] and [r.rows for r in table.ledger().collect()] == [3, 3, 3]
    with pytest.raises(Drift, match="later versions"):
        table.create(table.read(1))


def test_drift_is_refused(spark, tmp_path):
    root = f"{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    VersionedTable(spark, root).create(rows)
    VersionedTable(spark, root, STEPS[:1]).migrate()
    with pytest.raises(Drift, match="steps differ"):
        VersionedTable(spark, root, [Step(2, "upper", {"name": "lower(name)"})]).migrate()
    rows.write.mode("append").parquet(f"{root}/v=2")
    with pytest.raises(Drift, match="rows of version 2"):
        VersionedTable(spark, root, STEPS).migrate()
    with pytest.raises(ValueError):
        VersionedTable(spark, root, STEPS[1:])
    with pytest.raises(Drift, match="nothing is recorded"):
        VersionedTable(spark, f"{tmp_path}/none", STEPS).migrate()


def test_empty_table_moves_as_well(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", STEPS)
    table.create(spark.createDataFrame([], "id int, name string"))
    assert table.migrate() == [2, 3] and table.read().columns == ["name", "size"]


def test_replay_goes_on_where_it_broke_off(spark, tmp_path):
    files, target, checkpoint = (f"{tmp_path}/{p}" for p in ("files", "out", "ckpt"))
    events = spark.range(20).selectExpr("id as event_id", "id % 3 as kind")
    for part in range(4):
        events.where(f"event_id % 4 = {part} or event_id = 7").coalesce(1).write.mode("append").parquet(files)
    seen = []

    def breaks_at_third(rows, folder, number):
        spool.write_batch(rows, folder, number)
        seen.append(number)
        if seen == [0, 1, 2]:
            raise RuntimeError("between write and commit")

    with pytest.raises(StreamingQueryException):
        spool.replay_spool(spark, files, target, checkpoint, events.schema, 1, breaks_at_third)
    spool.replay_spool(spark, files, target, checkpoint, events.schema, 1, breaks_at_third)
    assert seen == [0, 1, 2, 2, 3]
    assert spark.read.parquet(target).count() == 23  # one event was spooled four times
    once = spool.delivered(spark, target, events.schema, ["event_id"], ["kind"])
    assert sorted(r.event_id for r in once.collect()) == list(range(20))
    spool.replay_spool(spark, files, target, checkpoint, events.schema, 1, breaks_at_third)
    assert len(seen) == 5  # nothing new, nothing done


def test_a_long_text_is_prepared_once(spark):
    """Stripping and lower-casing stand once in the plan, however many words are looked for."""
    rows = spark.createDataFrame([(1, " System: a, b\nTimeline of the DATABASE; log ")], "i int, request string")
    parsed = R.parse_requests(rows)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("regexp_replace(request") == 1
    got = parsed.first().parsed
    assert (got.query, got.systems, got.outputs, got.source_types, got.live_verification) == ("System: a, b\nTimeline of the DATABASE; log", ["a", "b"], ["timeline"], ["log"], True)
