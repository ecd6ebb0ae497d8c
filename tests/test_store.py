from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attesta.functions.vectors import hash_vector
from attesta.operators import namespaces, store
from attesta.operators.filters import RetrievalFilters
from attesta.plans import retrieval
from attesta.plans.admin import Administration, SpaceRegistry, guard_privacy
from attesta.platform import Platform

CODE = "import os\n\nclass Pay:\n    def run(self):\n        return load()\n\ndef load():\n    logger.error('x')\n"


def raw(spark, *rows):
    schema = "source_id string, source_uri string, content string, domain_id string, system_id string, acl_scope string, source_type string, metadata map<string,string>, ingest_ts timestamp"
    return spark.createDataFrame([(*r, datetime(2024, 5, 1)) for r in rows], schema)


@pytest.fixture(scope="module")
def platform(spark, tmp_path_factory):
    p = Platform(spark, str(tmp_path_factory.mktemp("store")), dimension=64)
    p.ingest(
        raw(
            spark,
            ("s1", "docs/a.md", "alpha beta\n\ngamma password=hunter2", "criminal", "sys", "internal", "document", {"api_key": "KEY-123", "owner": "KEY-123 team"}),
            ("s2", "src/pay.py", CODE, "criminal", "sys", "internal", "code", {}),
            ("s3", "docs/c.md", "alpha beta secret decoy KEY-123", "criminal", "sys", "restricted", "document", {}),
        ),
        "b1",
    )
    return p


def test_ingest_writes_every_table(platform):
    s = platform.store
    assert s.read("source_versions").count() == 3
    assert s.read("chunks").groupBy("source_id").count().count() == 3
    assert s.read("embeddings").count() == s.read("chunks").count()
    assert s.read("artifacts").count() == 3 and s.read("objects").count() == 3 and s.read("namespaces").count() >= 2
    names = {r.qualified_name: r.line_start for r in s.read("code_symbols").collect()}
    assert names == {"Pay": 3, "Pay.run": 4, "Pay.load": 7}
    relations = {(r.relation_type, r.target, r.resolved) for r in s.read("code_relationships").collect()}
    assert ("calls", "load", True) in relations and ("logging", "logging", False) in relations


def test_redaction_happens_before_storage(platform):
    texts = {r.source_id: r.text for r in platform.store.read("chunks").where("ordinal > 0 or source_id != 's1'").collect()}
    assert "hunter2" not in texts["s1"] and "[redacted]" in texts["s1"]
    assert platform.store.read("sources").where("source_id = 's1'").first().metadata == {"api_key": "[redacted]", "owner": "KEY-123 team"}


def test_save_is_idempotent_and_versions_count_up(platform, spark):
    again = raw(spark, ("s1", "docs/a.md", "alpha beta\n\ngamma password=hunter2", "criminal", "sys", "internal", "document", {"api_key": "KEY-123"}), ("s1", "docs/a.md", "brand new text", "criminal", "sys", "internal", "document", {}))
    flags = {r.version_number: r.created for r in platform.ingest(again, "b2").collect()}
    assert flags == {1: False, 2: True}
    before = platform.store.read("chunks").count()
    platform.ingest(again, "b2")  # a replayed batch changes nothing
    assert platform.store.read("chunks").count() == before
    latest = platform.store.provenance(RetrievalFilters(source_ids=("s1",))).select("version_number").distinct().collect()
    assert [r.version_number for r in latest] == [2]


def test_search_is_scoped_and_ranked(platform):
    hits = platform.search("alpha beta", RetrievalFilters(principal_acl_scopes=("internal",), limit=1, neighbor_window=1), record="ev1")
    rows = hits.orderBy(F.desc("score")).collect()
    assert rows[0].text == "alpha beta" and rows[0].acl_scope == "internal"
    assert all("decoy" not in r.text for r in rows)
    assert [r.neighboring_chunk_ids for r in rows[1:]] == [[rows[0].chunk_id]]
    event = platform.store.read("retrieval_events").first()
    assert event.selected_chunks[0] == rows[0].chunk_id and set(event.scores) == {r.chunk_id for r in rows}


def test_scope_filter_runs_below_the_python_scorer(platform, spark):
    f = RetrievalFilters(principal_acl_scopes=("internal",), domain_ids=("criminal",))
    chunks, vectors = platform.store.read("chunks"), platform.store.read("embeddings")
    scores = retrieval.hybrid_scores(chunks, vectors, "alpha", hash_vector("alpha", 64), f)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "In(acl_scope" in plan or "EqualTo(acl_scope,internal)" in plan
    assert "CartesianProduct" not in plan
    node = scores._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    carried = {node.children().apply(i).output().apply(j).name() for i in range(2) for j in range(node.children().apply(i).output().size())}
    assert carried == {"chunk_id", "ordinal", "lexical_score", "semantic_score"}  # no text or vector is shuffled


def test_space_mismatch_is_refused(platform):
    with pytest.raises(retrieval.EmbeddingSpaceMismatch):
        platform.search("alpha", RetrievalFilters(embedding_space_id="other:64:v1")).collect()
    with pytest.raises(ValueError):
        retrieval.candidates(*[platform.store.read(t) for t in ("chunks", "sources", "source_versions", "artifacts", "embeddings")], RetrievalFilters())


def test_status_retire_and_legal_hold(platform, spark):
    admin = Administration(platform.store, "tester")
    assert {r.source_id: r.versions for r in platform.store.status(RetrievalFilters()).collect()}["s1"] == 2
    with pytest.raises(ValueError):
        admin.retire("s1", " ")
    with pytest.raises(KeyError):
        admin.retire("nope", "old")
    assert admin.retire("s1", "old")["status"] == "complete"
    assert {r.source_id for r in platform.store.list_sources(RetrievalFilters()).collect()} == {"s2", "s3"}
    assert platform.store.list_sources(RetrievalFilters(), include_retired=True).count() == 3
    created = platform.store.current("sources").where("source_id = 's1'").first().created_at
    assert created == datetime(2024, 5, 1)
    platform.ingest(raw(spark, ("held", "h.md", "held text", "criminal", "sys", "internal", "document", {"legal_hold": "true"})), "b-held")
    with pytest.raises(PermissionError):
        admin.retire("held", "why not")
    log = platform.store.read("admin_operations").where("operation = 'retire'").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in log} == {"running": 1, "complete": 1}


def test_reembed_is_resumable(platform):
    admin = Administration(platform.store)
    assert admin.reembed("hash-32:32:v1", limit=2)["status"] == "paused"
    assert admin.reembed("hash-32:32:v1")["status"] == "complete"
    assert admin.reembed("hash-32:32:v1", provider="CLOUD", privacy="local_only")["status"] == "failed"
    counts = platform.store.read("embeddings").groupBy("embedding_space_id").agg(F.count_distinct("chunk_id").alias("n")).collect()
    assert len({r.n for r in counts}) == 1 and len(counts) == 2


def test_backup_and_symbol_search(platform, spark, tmp_path):
    platform.backup(str(tmp_path / "copy"))
    copy = store.EvidenceStore(spark, str(tmp_path / "copy"))
    assert copy.read("chunks").count() == platform.store.read("chunks").count()
    assert [r.qualified_name for r in platform.search_code_symbols("run class").collect()] == ["Pay", "Pay.run"]


def test_space_registry_and_privacy():
    spaces = SpaceRegistry("a:8:v1")
    spaces.register("b:8:v1", "CLOUD")
    with pytest.raises(ValueError):
        spaces.switch("b:8:v1")
    with pytest.raises(KeyError):
        spaces.switch("c:8:v1", corpus_ready=True)
    spaces.switch("b:8:v1", corpus_ready=True)
    with pytest.raises(PermissionError):
        guard_privacy("CLOUD", "local_only")


def test_namespace_hints_and_edges(spark):
    rows = spark.createDataFrame([("criminal", None, "c1", "log"), ("other", " ", None, None)], "domain_id string, system_id string, component_id string, evidence_type string")
    got = {r.domain_id: r for r in namespaces.describe(rows).collect()}
    assert (got["criminal"].system_id, got["criminal"].environment, got["criminal"].acl_scope) == ("criminal_casework", "prod", "internal")
    assert (got["other"].system_id, got["other"].component_id, got["other"].environment, got["other"].evidence_type) == ("unknown-system", "unknown-component", "unknown", "document")
    assert got["other"].sanitized_summary == "other/unknown-system/unknown-component [document] in unknown"
    spec = "array<struct<relation_type:string,target:struct<domain_id:string,system_id:string,component_id:string,environment:string,evidence_type:string,acl_scope:string>>>"
    linked = namespaces.describe(rows).withColumn("integration_edges", F.when(F.col("domain_id") == "other", F.from_json(F.lit('[{"target":{"domain_id":"criminal"}},{"relation_type":"feeds","target":{}}]'), spec)))
    targets, edges = namespaces.edges(linked)
    assert {(r.relation_type, r.domain_id) for r in edges.collect()} == {("integrates-with", "other"), ("feeds", "other")}
    assert targets.count() == 2


def test_unknown_chunks_get_no_embedding(platform, spark):
    rows = spark.createDataFrame([("nope", "x:1:v1", [1.0])], "chunk_id string, embedding_space_id string, vector array<float>")
    platform.store.save_embeddings(rows, "dangling")
    assert platform.store.read("embeddings").where("embedding_space_id = 'x:1:v1'").count() == 0


def test_schema_drift_is_refused(spark, tmp_path):
    s = store.EvidenceStore(spark, str(tmp_path / "m"))
    assert "chunks" in s.migrate() and s.migrate() == []
    s.append("schema_migrations", spark.createDataFrame([("chunks", "other")], "version string, checksum string"), "tampered")
    with pytest.raises(RuntimeError):
        s.migrate()


def test_handoffs_name_foreign_edges(spark):
    from attesta.plans import search_tools

    packages = spark.createDataFrame([("p1", "n1"), ("p2", "n2")], "package_id string, namespace_id string")
    edges = spark.createDataFrame([("n1", "encargos_sigef", "e1"), ("n2", "criminal", "e2")], "source_namespace_id string, target_domain_id string, edge_id string")
    assert [r.package_id for r in search_tools.handoffs(packages, edges, "criminal").collect()] == ["p1"]
