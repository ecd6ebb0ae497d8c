"""End-to-end correlation: token budget, left-out evidence, dropped domains, explicit edges or implied ones."""

import random
from datetime import datetime

import pytest

import __spark_entry__ as entry
from attesta.plans import correlate as C
from attesta.plans import profiles

COLUMNS = "chunk_id string, source_id string, source_version_id string, ordinal long, text string, source_uri string, locator string, chunk_hash string, domain_id string, system_id string, component_id string, environment string, source_type string, evidence_type string, acl_scope string, ingest_ts timestamp"


@pytest.fixture(scope="module")
def evidence(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        domain = list(profiles.DOMAINS)[i % len(profiles.DOMAINS)]
        text = "handled error " * rng.randint(1, 30) + ("handoff" if i % 4 else "")
        rows.append((f"c{i:02}", f"s{i:02}", f"v{i:02}", 0, text, f"u{i}", f"u{i}:L1", f"h{i}", domain, "pay", "comp", "prod", "log", "log", "internal", datetime(2024, 1, 1)))
    return rows, spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("budget", [1, 60, 150, 10_000])
def test_token_budget_is_a_greedy_fold_over_domains_in_turn(evidence, budget):
    _, df = evidence
    domains = list(profiles.DOMAINS)[:3]
    request = C.CorrelationRequest("error handoff", domain_ids=domains, evidence_budget=9)
    hits = [r.asDict() for r in C.within_tokens(C.domain_hits(df, request, domains), domains, budget).collect()]
    used, kept = 0, set()
    for h in sorted(hits, key=lambda h: (h["rank"], domains.index(h["domain_id"]))):
        tokens = max(1, (len(h["text"]) + 3) // 4)
        if used + tokens <= budget:
            used, kept = used + tokens, kept | {h["chunk_id"]}
    assert {h["chunk_id"] for h in hits if h["kept"]} == kept and len(hits) == 9


def test_what_is_left_out_comes_back(evidence):
    rows, df = evidence
    assert len(profiles.DOMAINS) > 4
    request = C.CorrelationRequest("error handoff", domain_ids=list(profiles.DOMAINS), evidence_budget=12, token_budget=80)
    found = C.correlate(df, request).first()
    assert len(found.selected_domain_ids) == 4 and len(found.dropped_domain_ids) == len(profiles.DOMAINS) - 4
    missing = [f.statement for f in found.findings if f.classification == "missing_evidence"]
    assert len(missing) == len(found.dropped_domain_ids) + len(found.left_out) and any("token budget" in m for m in missing)
    assert sum(o.hits for o in found.left_out) + found.references == 12
    assert found.estimated_tokens <= 80 + 4 and len(found.edges) == 12  # an empty domain still counts one token
    whole = C.correlate(df, C.CorrelationRequest("error handoff", domain_ids=list(profiles.DOMAINS)[:2], evidence_budget=4)).first()
    assert list(whole.left_out) == [] and not any(f.classification == "missing_evidence" for f in whole.findings)
    assert {(e.source_domain_id, e.relation_type) for e in whole.edges} == {(d, "handoff") for d in whole.selected_domain_ids}


def test_registered_edges_stand_in_for_implied_ones(spark, evidence):
    _, df = evidence
    a, b, c = list(profiles.DOMAINS)[:3]
    edges = spark.createDataFrame([("e2", a, b, "calls"), ("e1", a, b, "calls"), ("e3", a, None, "calls"), ("e4", c, a, "calls")], "edge_id string, source_domain_id string, target_domain_id string, relation_type string")
    request = C.CorrelationRequest("error", domain_ids=[a, b], evidence_budget=4)
    assert [e.edge_id for e in C.correlate(df, request, edges).first().edges] == ["e1"]
    assert len(C.correlate(df, request, edges.where("edge_id = 'e4'")).first().edges) == 2  # none starts in a selected domain


def test_each_request_has_explicit_edges_or_else_implied_ones(spark):
    explicit = spark.createDataFrame([("r1", "a", "b", "x", 2), ("r1", "a", "b", "x", 1), ("r1", "b", "c", "y", 3), ("r2", "a", None, "x", 1), ("r5", "a", "", "x", 1)], "request_id string, source_domain_id string, target_domain_id string, relation_type string, n int")
    requests = spark.createDataFrame(
        [("r1", "handoff", ["a", "b", "c"]), ("r2", "Who has OWNERSHIP", ["a", "b"]), ("r3", "?", ["a"]), ("r4", None, ["a", "b"]), ("r5", "delegate", ["a", "b", "c"])],
        "request_id string, question string, domain_ids array<string>",
    )
    got = {tuple(r) for r in C.request_edges(explicit, requests, ["n"]).collect()}
    both = lambda r, names, kind: {(r, s, t, kind, "implied") for s in names for t in names if s != t}
    assert got == {("r1", "a", "b", "x", "explicit"), ("r1", "b", "c", "y", "explicit")} | both("r2", "ab", "case-reference") | both("r4", "ab", "integration-correlation") | both("r5", "abc", "delegates-to")
    rows = entry.queries()["edges_explicit_else_implied"](spark, "/root/testdata/sf0.01").collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.conv_id, set()).add(r.origin)
    assert {frozenset(k) for k in kinds.values()} == {frozenset({"explicit"}), frozenset({"implied"})}
    plan = C.request_edges(explicit, requests, ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
