"""Every registered query against its SQL formulation on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not mounted")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return v.isoformat(sep=" ") if hasattr(v, "isoformat") else str(v)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, con):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, df.collect())
    cursor = con.execute(ORACLES[name])
    assert got == canonical([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_no_cross_joins_in_heavy_queries(spark):
    for name in ("lexical_topk", "hybrid_topk", "bench_rank_lexical", "frame_code_join", "neighbor_expansion", "domain_fan_in", "version_numbers", "dlq_attempts", "audit_finding_counts", "audit_cross_source", "audit_report"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_audit_steps_join_nothing_by_constant(spark):
    """The steps that look at all findings are read without the checkpoints between them."""
    from attesta.plans import audit
    from attesta.sources import corpus

    request = audit.AuditRequest("billing failure timeout")
    hits = audit.audit_hits(corpus.evidence(spark, SF), request)
    found = audit.observations(hits, request)
    covered = audit.coverage_findings(found, audit.timeline(hits), request)
    for step in (covered, audit.cross_source_findings(found.unionByName(covered), hits, request)):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
