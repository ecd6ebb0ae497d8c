"""Cross-domain correlation: budgeted retrieval per domain, facts, graph and findings.

All domains are answered by one scan: hits are ranked within their domain and cut to that
domain's share of the evidence budget. Everything after that is bounded by the budget.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import extract, ids
from attesta.functions import text as T
from attesta.operators import packaging, ranking
from attesta.operators.ranking import first_per_key
from attesta.plans import profiles, router
from attesta.plans import search_tools as ST
from attesta.session import cut_lineage

# Budgets, mode names and relation keywords.
MAX_EVIDENCE = 16
DEFAULT_EVIDENCE = 8
DEFAULT_TOKENS = 12_000
EXPLICIT_MODES = {"exact": "code_exact", "symbol": "code_symbols", "logs": "logs", "docs": "docs", "schema": "schema", "query_outputs": "query_outputs"}
IMPLIED_RELATION = "integration-correlation"
RELATIONS = [("handoff", "handoff"), ("ownership", "case-reference"), ("case", "case-reference"), ("delegate", "delegates-to")]


@dataclass(frozen=True)
class CorrelationRequest:
    question: str
    domain_ids: Sequence[str] = ()
    systems: Sequence[str] = ()
    components: Sequence[str] = ()
    correlation_ids: Sequence[str] = ()
    request_ids: Sequence[str] = ()
    session_ids: Sequence[str] = ()
    source_types: Sequence[str] = ()
    since: datetime | None = None
    until: datetime | None = None
    evidence_budget: int = DEFAULT_EVIDENCE
    token_budget: int = DEFAULT_TOKENS
    mode: str = "domain_evidence"
    acl_scopes: Sequence[str] = ()


def fair_share(budget: Column, parts: Column, index: Column, cap: int = MAX_EVIDENCE) -> Column:
    """Share of one of ``parts`` consumers: the floor, plus one for the first remainder ones."""
    total = F.greatest(F.lit(1), F.least(F.lit(cap), budget))
    base = F.greatest(F.lit(1), F.floor(total / parts))
    return F.least(F.lit(cap), base + F.when(index < total % parts, F.lit(1)).otherwise(F.lit(0))).cast("long")


def shares(budget: int, domains: Sequence[str], cap: int = MAX_EVIDENCE) -> dict[str, int]:
    total, n = max(1, min(cap, budget)), max(1, len(domains))
    return {d: min(cap, max(1, total // n) + (1 if i < total % n else 0)) for i, d in enumerate(domains)}


def retrieval_mode(question: Column, source_types: Column, explicit: Column) -> Column:
    """Tool chosen for a question: explicit mode, then identifiers, then a single source type."""
    lowered, only = F.lower(question), F.when(F.size(source_types) == 1, source_types[0])
    about_ids = F.rlike(lowered, F.lit("correlation id|request id|session id"))
    return (
        F.when(explicit.isin(list(EXPLICIT_MODES)), explicit)
        .when((only == "log") | about_ids, F.lit("logs"))
        .when(only == "code", F.when(F.contains(T.strip(question), F.lit(" ")), F.lit("symbol")).otherwise(F.lit("exact")))
        .when(only == "schema", F.lit("schema"))
        .when(only == "query-output", F.lit("query_outputs"))
        .otherwise(F.lit("domain_evidence"))
    )


def choose_mode(request: CorrelationRequest) -> str:
    """Driver-side form of :func:`retrieval_mode` for one request."""
    explicit, lowered, types = request.mode.strip().lower(), request.question.lower(), tuple(request.source_types)
    if explicit in EXPLICIT_MODES:
        return explicit
    if types == ("log",) or any(f"{k} id" in lowered for k in ("correlation", "request", "session")):
        return "logs"
    if types == ("code",):
        return "symbol" if " " in request.question.strip() else "exact"
    return {("schema",): "schema", ("query-output",): "query_outputs"}.get(types, "domain_evidence")


def domain_hits(chunks: DataFrame, request: CorrelationRequest, domains: Sequence[str]) -> DataFrame:
    """Budgeted hits of every selected domain from one scan, ranked within the domain."""
    mode = choose_mode(request)
    tool = EXPLICIT_MODES.get(mode, mode)
    systems = router.partition_systems(request.systems, domains)
    types = list(request.source_types) or list(ST.TOOL_SOURCE_TYPES[tool])
    inside = lambda d: (F.col("domain_id") == d) & (F.col("system_id").isin(list(systems[d])) if systems[d] else F.lit(True))
    scope = reduce(lambda a, b: a | b, [inside(d) for d in domains]) & F.col("domain_id").isin(list(domains)) & F.col("source_type").isin(types)
    if request.acl_scopes:
        scope = scope & F.col("acl_scope").isin(list(request.acl_scopes))
    if request.components:
        scope = scope & F.col("component_id").isin(list(request.components))
    asked = ST.SearchRequest(
        request.question, correlation_ids=request.correlation_ids, request_ids=request.request_ids, session_ids=request.session_ids, since=request.since, until=request.until
    )
    scored = ST.SCORERS.get(tool, ST.lexical_hits)(chunks.where(scope), asked)
    budget = shares(request.evidence_budget, domains)
    limit = F.lit(0)
    for domain, share in budget.items():
        limit = F.when(F.col("domain_id") == domain, F.lit(share)).otherwise(limit)
    # The constant bound is what Spark pushes below the shuffle; the per-domain share trims it.
    return ranking.top_k_per(scored, ["domain_id"], max(budget.values())).where(F.col("rank") <= limit)


def within_tokens(hits: DataFrame, domains: Sequence[str], budget: int) -> DataFrame:
    """The hits with ``kept``: whether the token budget of the request holds them.

    Domains take turns: the best hit of each, then the second of each, and so on; a hit that no
    longer fits is passed over, smaller ones behind it may still fit. The hits of one request are
    bounded by its evidence budget, so their order is one small array and the budget one fold.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain_id"))
    turns = F.array_sort(F.collect_list(F.struct("rank", place.alias("place"), "chunk_id", T.estimated_tokens(F.col("text")).alias("tokens"))))
    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def take(state: Column, hit: Column) -> Column:
        more = F.struct((state["used"] + hit["tokens"]).alias("used"), F.concat(state["kept"], F.array(hit["chunk_id"])).alias("kept"))
        return F.when(state["used"] + hit["tokens"] <= budget, more).otherwise(state)

    kept = hits.agg(turns.alias("turns")).select(F.explode(F.aggregate("turns", nothing, take)["kept"]).alias("chunk_id"), F.lit(True).alias("kept"))
    return hits.join(F.broadcast(kept), "chunk_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def left_out(hits: DataFrame) -> DataFrame:
    """``domain_id, hits, tokens, references`` of what the token budget does not hold."""
    refs = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "source_id", "locator").alias("r"))))["r"]
    return hits.where(~F.col("kept")).groupBy("domain_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"), refs.alias("references"))


def domain_packages(hits: DataFrame, request: CorrelationRequest) -> DataFrame:
    packed = packaging.package_hits(hits, request.question, choose_mode(request))
    return packed


def delegations(hits: DataFrame, request: CorrelationRequest, domains: Sequence[str]) -> DataFrame:
    """One row per selected domain: packages, references, identifiers, times and sizes."""
    spark = hits.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(d) for d in domains])).alias("position", "domain_id"))
    text = F.col("text")
    marked = hits.withColumns({"cids": extract.typed_ids(text, "correlation"), "ts": extract.timestamps(text), "ref": F.concat_ws(":", "source_id", "locator")})
    order = F.struct("rank", "chunk_id")
    per = marked.groupBy("domain_id").agg(
        F.count_distinct("source_version_id").alias("package_count"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("ref").alias("r"))))["r"].alias("provenance_refs"),
        F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("cids").alias("c"))))["c"])).alias("correlation_ids"),
        F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("ts").alias("t"))))["t"])).alias("timestamps"),
        F.sum(T.estimated_tokens(text)).alias("estimated_tokens"),
        F.sum(T.estimated_bytes(text)).alias("estimated_bytes"),
    )
    empty = F.array().cast("array<string>")
    joined = listed.join(F.broadcast(per), "domain_id", "left")
    return joined.withColumns(
        {
            "package_count": F.coalesce("package_count", F.lit(0)).cast("long"), "provenance_refs": F.coalesce("provenance_refs", empty), "correlation_ids": F.coalesce("correlation_ids", empty),
            "timestamps": F.coalesce("timestamps", F.array().cast("array<timestamp>")), "estimated_tokens": F.greatest(F.lit(1), F.coalesce("estimated_tokens", F.lit(0))), "estimated_bytes": F.greatest(F.lit(1), F.coalesce("estimated_bytes", F.lit(0))),
            "status": F.lit("ok"), "error_code": F.lit(None).cast("int"), "error_message": F.lit(None).cast("string"),
        }
    )


def failed_delegation(spark_rows: DataFrame, domain_id: str, error: Exception) -> DataFrame:
    """The delegation row of a domain that could not be searched."""
    code = next((c for kind, c in ((PermissionError, 403), (KeyError, 404), (NotImplementedError, 501)) if isinstance(error, kind)), 500)
    return spark_rows.withColumns(
        {"status": F.when(F.col("domain_id") == domain_id, F.lit("failed")).otherwise(F.col("status")), "error_code": F.when(F.col("domain_id") == domain_id, F.lit(code)).otherwise(F.col("error_code")), "error_message": F.when(F.col("domain_id") == domain_id, F.lit(str(error))).otherwise(F.col("error_message"))}
    )


def display_name(domain: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in profiles.DOMAIN_NAMES.items() for x in kv]), domain), domain)


def domain_facts(rows: DataFrame) -> DataFrame:
    """Facts, inferences and hypotheses about each domain's retrieval."""
    name, n = display_name(F.col("domain_id")), F.col("package_count")
    facts = F.array(
        F.struct(F.lit("fact").alias("classification"), F.concat(name, F.lit(" retrieval produced "), n.cast("string"), F.lit(" evidence package(s).")).alias("statement"), F.when(n > 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("confidence")),
        F.when(n > 1, F.struct(F.lit("inference").alias("classification"), F.concat(name, F.lit(" evidence remained compact within the requested budget.")).alias("statement"), F.lit(0.84).alias("confidence"))),
        F.when(n == 0, F.struct(F.lit("hypothesis").alias("classification"), F.concat(F.lit("No direct evidence was located for "), name, F.lit(" within the bounded request window.")).alias("statement"), F.lit(0.55).alias("confidence"))),
    )
    return rows.where("status = 'ok'").select("position", "domain_id", F.inline(F.array_compact(facts)))


def relation_type(question: str) -> str:
    lowered = question.lower()
    return next((relation for word, relation in RELATIONS if word in lowered), IMPLIED_RELATION)


def explicit_edges(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """One edge per (source, target, relation), the first one wins."""
    return first_per_key(edges.where(F.coalesce(F.col("target_domain_id"), F.lit("")) != ""), ["source_domain_id", "target_domain_id", "relation_type"], order)


def implied_edges(rows: DataFrame, request: CorrelationRequest) -> DataFrame:
    """Edges in both directions between the selected domains.

    The domains are capped at ``router.MAX_DOMAINS``, so the whole list is one small array
    and its pairs are formed inside it.
    """
    relation = relation_type(request.question)
    members = rows.agg(F.array_sort(F.collect_list(F.struct("position", "domain_id", "provenance_refs", "correlation_ids"))).alias("d"))
    pairs = F.flatten(
        F.transform(
            "d",
            lambda a: F.transform(F.filter("d", lambda b: b["position"] > a["position"]), lambda b: F.array(F.struct(a.alias("s"), b.alias("t"), a.alias("left"), b.alias("right")), F.struct(b.alias("s"), a.alias("t"), a.alias("left"), b.alias("right")))),
        )
    )
    flat = members.select(F.inline(F.flatten(pairs)))
    asked = F.array(*[F.lit(c) for c in request.correlation_ids]).cast("array<string>")
    return flat.select(
        ids.scoped_id("edge", F.lit(request.question), F.col("s.domain_id"), F.col("t.domain_id"), F.lit(relation)).alias("edge_id"),
        F.col("s.domain_id").alias("source_domain_id"), F.col("t.domain_id").alias("target_domain_id"), F.lit(relation).alias("relation_type"),
        F.array_distinct(F.concat(asked, F.col("left.correlation_ids"), F.col("right.correlation_ids"))).alias("correlation_ids"),
        F.array_distinct(F.concat(F.col("left.provenance_refs"), F.col("right.provenance_refs"))).alias("provenance_refs"),
        F.col("left.position").alias("left_position"), F.col("right.position").alias("right_position"), (F.col("s.position") > F.col("t.position")).alias("reverse"),
    )


def relation_of(question: Column) -> Column:
    """Column form of :func:`relation_type`."""
    relation = F.lit(IMPLIED_RELATION)
    for word, name in reversed(RELATIONS):
        relation = F.when(F.contains(F.lower(question), F.lit(word)), F.lit(name)).otherwise(relation)
    return relation


def request_edges(explicit: DataFrame, requests: DataFrame, order: Sequence[str]) -> DataFrame:
    """Edges of many requests in one plan: a request's explicit edges, or else the implied ones.

    ``explicit`` has ``request_id, source_domain_id, target_domain_id, relation_type`` and the columns
    of ``order``; the first of equal edges stays, and edges without target do not count. A request
    (``request_id, question, domain_ids``) none of whose edges is left gets both directions between
    each two of its domains. The domains of a request are a short array, so its pairs are formed in
    the row; the only shuffles are by request.
    """
    keys = ["request_id", "source_domain_id", "target_domain_id", "relation_type"]
    stated = first_per_key(explicit.where(F.coalesce(F.col("target_domain_id"), F.lit("")) != ""), keys, order)
    open_ = requests.join(stated.select("request_id"), "request_id", "left_anti")
    pairs = F.flatten(F.transform("domain_ids", lambda s: F.transform(F.filter("domain_ids", lambda t: t != s), lambda t: F.struct(s.alias("source_domain_id"), t.alias("target_domain_id")))))
    implied = open_.select("request_id", relation_of(F.col("question")).alias("relation_type"), F.inline(pairs)).select(*keys)
    return stated.select(*keys, F.lit("explicit").alias("origin")).unionByName(implied.select(*keys, F.lit("implied").alias("origin")))


def correlate(chunks: DataFrame, request: CorrelationRequest, edges: DataFrame | None = None) -> DataFrame:
    """One row: the whole correlation of a request, from the choice of domains to the summary.

    ``edges`` are registered integration edges (``edge_id, source_domain_id, target_domain_id,
    relation_type``); without one that starts in a selected domain the edges are implied. What the
    limits leave out, hits beyond the token budget and domains beyond the fan-out, comes back in
    ``left_out``, ``dropped_domain_ids`` and as missing evidence among the findings.
    """
    every = router.select_domains(request.domain_ids, request.systems, request.components, request.question, max_domains=len(profiles.DOMAINS))
    domains, dropped = every[: router.MAX_DOMAINS], every[router.MAX_DOMAINS :]
    hits = cut_lineage(within_tokens(cut_lineage(domain_hits(chunks, request, domains)), domains, request.token_budget))
    rows = cut_lineage(delegations(hits.where("kept"), request, domains))
    over = left_out(hits)
    graph = implied_edges(rows, request)
    if edges is not None:
        registered = explicit_edges(edges.where(F.col("source_domain_id").isin(list(domains))), ["edge_id"]).select("edge_id", "source_domain_id", "target_domain_id", "relation_type")
        if not registered.isEmpty():
            zero = F.lit(0)
            graph = registered.withColumns({"left_position": zero, "right_position": zero, "reverse": F.lit(False)})
    name = display_name(F.col("domain_id"))
    unread = over.select(
        F.lit("missing_evidence").alias("classification"),
        F.concat(F.col("hits").cast("string"), F.lit(" evidence item(s) of "), name, F.lit(" ("), F.col("tokens").cast("string"), F.lit(" tokens) were left out by the token budget.")).alias("statement"),
        F.lit(0.58).alias("confidence"),
    )
    unasked = [("missing_evidence", f"{profiles.DOMAIN_NAMES.get(d, d)} was not searched: {len(domains)} domains are correlated at once.", 0.58) for d in dropped]
    found = graph_findings(rows, graph).unionByName(unread)
    if unasked:
        found = found.unionByName(chunks.sparkSession.createDataFrame(unasked, "classification string, statement string, confidence double"))

    def packed(df: DataFrame, *columns: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("all"))

    # a handful of rows each, bounded by domains and evidence budget: read here, and put into the one row
    listed = {
        "delegations": packed(rows, "position", "domain_id", "package_count", "estimated_tokens", "estimated_bytes", "provenance_refs"),
        "edges": packed(graph, "source_domain_id", "target_domain_id", "relation_type", "edge_id"),
        "findings": packed(found, "classification", "statement", "confidence"),
        "left_out": packed(over, "domain_id", "hits", "tokens", "references"),
    }
    whole = totals(rows)
    edge_count = graph.count()
    for column, table in listed.items():
        kind = table.schema["all"].dataType
        whole = whole.withColumn(column, F.from_json(F.lit(json.dumps(literal(table.first()["all"]))), kind))
    return whole.withColumns(
        {
            "correlation_id": correlation_id(request, domains),
            "selected_domain_ids": F.array(*[F.lit(d) for d in domains]), "dropped_domain_ids": F.array(*[F.lit(d) for d in dropped]).cast("array<string>"),
            "evidence_budget": F.lit(request.evidence_budget), "token_budget": F.lit(request.token_budget),
            "summary": F.lit(rows.agg(summary_text(rows, F.lit(edge_count)).alias("s")).first()["s"]),
        }
    )


def literal(value):
    """Rows of a bounded result as plain lists and objects."""
    if isinstance(value, list):
        return [literal(v) for v in value]
    return {k: literal(v) for k, v in value.asDict().items()} if hasattr(value, "asDict") else value


def graph_findings(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts of working domains, one inference over all edges, and what failed."""
    facts = domain_facts(rows).select("classification", "statement", "confidence")
    said = F.concat(display_name(F.col("source_domain_id")), F.lit(" links to "), display_name(F.col("target_domain_id")), F.lit(" via "), F.col("relation_type"))
    linked = edges.agg(F.array_sort(F.collect_list(F.struct("left_position", "right_position", "reverse", said.alias("said"))))["said"].alias("s")).where(F.size("s") > 0)
    inference = linked.select(F.lit("inference").alias("classification"), F.array_join("s", "; ").alias("statement"), F.lit(0.88).alias("confidence"))
    failed = rows.agg(F.count_if(F.col("status") != "ok").alias("n")).where("n > 0")
    guess = failed.select(F.lit("hypothesis").alias("classification"), F.concat(F.col("n").cast("string"), F.lit(" delegated retrieval task(s) failed within the bounded correlation run.")).alias("statement"), F.lit(0.61).alias("confidence"))
    missing = failed.select(F.lit("missing_evidence").alias("classification"), F.lit("One or more requested domains did not return retrieval evidence.").alias("statement"), F.lit(0.58).alias("confidence"))
    return facts.unionByName(inference).unionByName(guess).unionByName(missing)


def totals(rows: DataFrame) -> DataFrame:
    """Status and size of the whole correlation."""
    good, bad = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") != "ok")
    status = F.when(bad == 0, F.lit("ok")).when(good > 0, F.lit("partial")).otherwise(F.lit("failed"))
    return rows.agg(
        status.alias("status"), F.sum("package_count").alias("packages"), F.sum("estimated_tokens").alias("estimated_tokens"), F.sum("estimated_bytes").alias("estimated_bytes"),
        F.sum(F.size("provenance_refs")).alias("references"),
    )


def correlation_id(request: CorrelationRequest, domains: Sequence[str]) -> Column:
    stamp = lambda t: t.isoformat() if t else ""
    parts = (request.question, ",".join(domains), ",".join(request.correlation_ids), ",".join(request.request_ids), ",".join(request.session_ids), stamp(request.since), stamp(request.until))
    return ids.scoped_id("icorr", *[F.lit(p) for p in parts])


def summary_text(rows: DataFrame, edge_count: Column) -> Column:
    """Deterministic summary over the delegation rows."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", display_name(F.col("domain_id")).alias("n")))), lambda x: x["n"]), ", ")
    return F.concat(
        F.lit("Correlated "), F.count(F.lit(1)).cast("string"), F.lit(" domain(s) ["), names, F.lit("] with "), edge_count.cast("string"), F.lit(" integration edge(s) and "),
        F.sum(F.size("provenance_refs")).cast("string"), F.lit(" provenance-bearing evidence ref(s)."),
    )
