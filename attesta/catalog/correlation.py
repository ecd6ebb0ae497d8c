"""Domain inference, budgets, fan-in, graph and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import text as T
from attesta.operators import joins
from attesta.plans import correlate as C
from attesta.plans import profiles, router
from attesta.session import cut_lineage
from attesta.sources import corpus

_WORDS = ["sinquer", "SCO case", "judicial", "sigef encargos", "administrative and criminal", "nothing", "sicjut sigepra", "escopo"]
_NEEDLES = "[" + ", ".join(f"{{'n': '{n}', 'd': '{d}'}}" for n, d in profiles.DOMAIN_NEEDLES) + "]"
_QUESTIONS = f"q AS (SELECT conv_id, turn, text || ' ' || {S.choice('conv_id + turn', _WORDS)} AS question FROM conversations)"
_INFERRED = f"{_QUESTIONS}, inferred AS (SELECT *, list_filter({_NEEDLES}, lambda x: contains(lower(question), x.n)) AS found FROM q)"


def _questions(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", corpus.text_of(F.col("text"), " ", corpus._choice(F.col("conv_id") + F.col("turn"), _WORDS)).alias("question"))


_ORDERED = "(SELECT string_agg(d, ',' ORDER BY p) FROM (SELECT d, min(p) AS p FROM (SELECT unnest(found).d AS d, generate_subscripts(found, 1) AS p) GROUP BY d ORDER BY min(p) LIMIT {n}))"


@query("domain_inference", f"WITH {_INFERRED} SELECT conv_id, turn, coalesce({_ORDERED.format(n=99)}, '') AS domains FROM inferred")
def domain_inference(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(router.inferred_domains(F.col("question")), ",").alias("domains"))


@query(
    "route_plan",
    f"""WITH {_INFERRED}, sel AS (SELECT *, {_ORDERED.format(n=4)} AS domains FROM inferred), k AS (SELECT *, CASE WHEN contains(domains, ',') THEN 'integration_correlation' ELSE 'single_domain' END AS route_kind FROM sel WHERE domains IS NOT NULL)
 SELECT conv_id, turn, route_kind, CASE WHEN route_kind = 'single_domain' THEN domains ELSE 'integration_correlation' END AS delegate,
  'route_' || left(sha256('route' || chr(0) || question || chr(0) || route_kind || chr(0) || 'deterministic_alias' || chr(0) || 'local_preferred' || chr(0) || domains || chr(0)), 24) AS routing_id FROM k""",
)
def route_plan(spark, sf_dir):
    return router.route_plans(_questions(spark, sf_dir), "question").select("conv_id", "turn", "route_kind", "delegate", "routing_id")


_ALIASES = ["Sinquer", "SCO", "Encargos_SIGEF", "contencioso-judicial", "unknown thing", " judicial "]


@query(
    "alias_resolution",
    f"""SELECT c_custkey, {S.choice('c_custkey', ['criminal', 'contraordenacional', 'encargos_sigef', 'contencioso_judicial', '', 'contencioso_judicial'])} AS domain_id FROM customer""",
)
def alias_resolution(spark, sf_dir):
    named = corpus.table(spark, sf_dir, "customer").select("c_custkey", corpus._choice(F.col("c_custkey"), _ALIASES).alias("value"))
    rows = list({**profiles.DOMAIN_ALIASES, **{d: d for d in profiles.DOMAINS}}.items())
    aliases = spark.createDataFrame(rows, "alias string, domain_id string")
    return joins.alias_lookup(named, aliases).select("c_custkey", F.coalesce("domain_id", F.lit("")).alias("domain_id"))


@query(
    "retrieval_mode_choice",
    f"""WITH {_QUESTIONS} SELECT conv_id, turn, CASE (conv_id % 6) WHEN 0 THEN 'logs' WHEN 1 THEN 'symbol' WHEN 2 THEN 'schema' WHEN 3 THEN 'query_outputs' WHEN 4 THEN 'docs' ELSE 'domain_evidence' END AS mode FROM q""",
)
def retrieval_mode_choice(spark, sf_dir):
    types = F.array(corpus._choice(F.col("conv_id"), ["log", "code", "schema", "query-output", "document", "document"]))
    explicit = F.when(F.col("conv_id") % 6 == 4, F.lit("docs")).otherwise(F.lit("domain_evidence"))
    return _questions(spark, sf_dir).select("conv_id", "turn", C.retrieval_mode(F.col("question"), types, explicit).alias("mode"))


@query(
    "budget_split",
    """SELECT p_partkey, i, least(16, greatest(1, least(16, p_size) // n) + CASE WHEN i < least(16, p_size) % n THEN 1 ELSE 0 END)::BIGINT AS share
 FROM (SELECT p_partkey, p_size, p_partkey % 4 + 1 AS n FROM part), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i)""",
)
def budget_split(spark, sf_dir):
    parts = corpus.table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 4 + 1).alias("n"))
    spread = parts.select("p_partkey", "p_size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return spread.select("p_partkey", "i", C.fair_share(F.col("p_size"), F.col("n"), F.col("i")).alias("share"))


REQUEST = C.CorrelationRequest("error handled handoff of req-9", domain_ids=("criminal", "judicial", "sigef"), evidence_budget=10, acl_scopes=("internal", "public"))
SELECTED = router.select_domains(REQUEST.domain_ids)
_SHARES = C.shares(REQUEST.evidence_budget, SELECTED)
_LEX = S.lexical("text", T.query_terms(REQUEST.question))
_FAN = f"""{S.EVIDENCE}, ranked AS (SELECT *, {_LEX} AS lex, row_number() OVER (PARTITION BY domain_id ORDER BY {_LEX} DESC, ordinal, chunk_id) AS rank FROM evidence
   WHERE domain_id IN ('{"', '".join(SELECTED)}') AND acl_scope IN ('internal', 'public') AND source_type IN ('document', 'log', 'code', 'schema', 'query-output')),
 hits AS (SELECT * FROM ranked WHERE rank <= CASE domain_id {' '.join(f"WHEN '{d}' THEN {n}" for d, n in _SHARES.items())} END),
 doms AS (SELECT unnest(['{"', '".join(SELECTED)}']) AS domain_id, unnest([0, 1, 2]) AS position, unnest(['{"', '".join(profiles.DOMAIN_NAMES[d] for d in SELECTED)}']) AS name),
 deleg AS (SELECT d.domain_id, d.position, d.name, count(DISTINCT h.source_version_id) AS package_count, coalesce(string_agg(h.source_id || ':' || h.locator, ',' ORDER BY h.rank), '') AS refs,
   greatest(1, coalesce(sum(greatest(1, (length(h.text) + 3) // 4)), 0))::BIGINT AS estimated_tokens, greatest(1, coalesce(sum(strlen(h.text)), 0))::BIGINT AS estimated_bytes FROM doms d LEFT JOIN hits h ON h.domain_id = d.domain_id GROUP BY 1, 2, 3)"""


def _fan(spark, sf_dir):
    return C.domain_hits(corpus.evidence(spark, sf_dir), REQUEST, SELECTED)


def _delegations(spark, sf_dir):
    return C.delegations(_fan(spark, sf_dir), REQUEST, SELECTED)


@query("domain_fan_in", f"WITH {_FAN} SELECT domain_id, rank, chunk_id, round(lex * 0.25, 8) AS score FROM hits")
def domain_fan_in(spark, sf_dir):
    return _fan(spark, sf_dir).select("domain_id", "rank", "chunk_id", F.round("score", 8).alias("score"))


@query("domain_delegations", f"WITH {_FAN} SELECT domain_id, package_count, refs, estimated_tokens, estimated_bytes FROM deleg")
def domain_delegations(spark, sf_dir):
    return _delegations(spark, sf_dir).select("domain_id", "package_count", F.array_join("provenance_refs", ",").alias("refs"), "estimated_tokens", "estimated_bytes")


_FACTS = """facts AS (SELECT 'fact' AS classification, name || ' retrieval produced ' || package_count || ' evidence package(s).' AS statement, CASE WHEN package_count > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM deleg
 UNION ALL SELECT 'inference', name || ' evidence remained compact within the requested budget.', 0.84 FROM deleg WHERE package_count > 1)"""


@query("domain_facts", f"WITH {_FAN}, {_FACTS} SELECT * FROM facts")
def domain_facts(spark, sf_dir):
    return C.domain_facts(_delegations(spark, sf_dir)).select("classification", "statement", "confidence")


_PAIRS = """pairs AS (SELECT a.domain_id AS source_domain_id, b.domain_id AS target_domain_id, a.name AS sn, b.name AS tn, least(a.position, b.position) AS lp, greatest(a.position, b.position) AS rp, a.position > b.position AS rev FROM deleg a JOIN deleg b ON a.position <> b.position)"""


@query(
    "integration_graph_pairs",
    f"WITH {_FAN}, {_PAIRS} SELECT 'edge_' || left(sha256('edge' || chr(0) || '{REQUEST.question}' || chr(0) || source_domain_id || chr(0) || target_domain_id || chr(0) || 'handoff' || chr(0)), 24) AS edge_id, source_domain_id, target_domain_id, 'handoff' AS relation_type FROM pairs",
)
def integration_graph_pairs(spark, sf_dir):
    return C.implied_edges(_delegations(spark, sf_dir), REQUEST).select("edge_id", "source_domain_id", "target_domain_id", "relation_type")


@query(
    "graph_findings",
    f"""WITH {_FAN}, {_FACTS}, {_PAIRS} SELECT classification, statement, confidence FROM facts
 UNION ALL SELECT 'inference', string_agg(sn || ' links to ' || tn || ' via handoff', '; ' ORDER BY lp, rp, rev), 0.88 FROM pairs""",
)
def graph_findings(spark, sf_dir):
    rows = cut_lineage(_delegations(spark, sf_dir))
    return C.graph_findings(rows, C.implied_edges(rows, REQUEST))


@query(
    "correlation_totals",
    f"WITH {_FAN} SELECT 'ok' AS status, sum(package_count)::BIGINT AS packages, sum(estimated_tokens)::BIGINT AS estimated_tokens, sum(estimated_bytes)::BIGINT AS estimated_bytes, (SELECT count(*) FROM hits) AS \"references\" FROM deleg",
)
def correlation_totals(spark, sf_dir):
    return C.totals(_delegations(spark, sf_dir))


@query(
    "graph_edge_dedupe",
    """WITH e AS (SELECT sn.n_name AS source_domain_id, cn.n_name AS target_domain_id, l_returnflag AS relation_type, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
   JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey)
 SELECT source_domain_id, target_domain_id, relation_type, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY source_domain_id, target_domain_id, relation_type ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM e) WHERE rn = 1""",
)
def graph_edge_dedupe(spark, sf_dir):
    """Trade edges between supplier and customer nations, the first line item of each kept."""
    t = lambda n: corpus.table(spark, sf_dir, n)
    nations = t("nation").select("n_nationkey", "n_name")
    suppliers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source_domain_id"))
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("target_domain_id"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("relation_type"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    kept = edges.select("source_domain_id", "target_domain_id", "relation_type", "l_orderkey", "l_linenumber", "l_suppkey")
    return C.explicit_edges(kept, ["l_orderkey", "l_linenumber", "l_suppkey"])


#: A budget that holds some of the hits: the others come back as missing evidence.
FULL = C.CorrelationRequest("error handled handoff of req-9", domain_ids=("criminal", "judicial", "sigef", "sco"), evidence_budget=12, token_budget=170, acl_scopes=("internal", "public"))
_FULL_DOMAINS = router.select_domains(FULL.domain_ids)
_FULL_SHARES = C.shares(FULL.evidence_budget, _FULL_DOMAINS)
_FULL_SQL = f"""{S.EVIDENCE}, ranked AS (SELECT *, {S.lexical('text', T.query_terms(FULL.question))} AS lex FROM evidence
   WHERE domain_id IN ('{"', '".join(_FULL_DOMAINS)}') AND acl_scope IN ('internal', 'public') AND source_type IN ('document', 'log', 'code', 'schema', 'query-output')),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY lex DESC, ordinal, chunk_id) AS rank, greatest(1, (length(text) + 3) // 4) AS tokens,
   list_position(['{"', '".join(_FULL_DOMAINS)}'], domain_id) AS place FROM ranked),
 hits AS (SELECT *, row_number() OVER (ORDER BY rank, place) AS turn FROM numbered WHERE rank <= CASE domain_id {' '.join(f"WHEN '{d}' THEN {n}" for d, n in _FULL_SHARES.items())} END),
 fold AS (SELECT 0::BIGINT AS turn, 0::BIGINT AS used, NULL::VARCHAR AS taken
   UNION ALL SELECT h.turn, CASE WHEN used + tokens <= {FULL.token_budget} THEN used + tokens ELSE used END, CASE WHEN used + tokens <= {FULL.token_budget} THEN chunk_id END FROM fold f JOIN hits h ON h.turn = f.turn + 1),
 k AS (SELECT h.*, f.taken IS NOT NULL AS kept FROM hits h JOIN fold f USING (turn))"""


@query(
    "correlate_full",
    f"""WITH RECURSIVE {_FULL_SQL}, edges_ AS (SELECT count(*) AS n FROM (SELECT unnest(['{"', '".join(_FULL_DOMAINS)}']) AS a) x JOIN (SELECT unnest(['{"', '".join(_FULL_DOMAINS)}']) AS b) y ON a <> b)
 SELECT 'ok' AS status, count(DISTINCT source_version_id) FILTER (kept) AS packages, coalesce(sum(tokens) FILTER (kept), 0)::BIGINT AS tokens_kept,
  string_agg(source_id || ':' || locator, ',' ORDER BY place, rank) FILTER (NOT kept) AS left_out, coalesce(sum(tokens) FILTER (NOT kept), 0)::BIGINT AS tokens_left_out,
  (SELECT n FROM edges_)::BIGINT AS edges, count(DISTINCT domain_id) FILTER (NOT kept) AS missing_evidence,
  'Correlated {len(_FULL_DOMAINS)} domain(s) [{", ".join(profiles.DOMAIN_NAMES[d] for d in _FULL_DOMAINS)}] with ' || (SELECT n FROM edges_) || ' integration edge(s) and ' || count(*) FILTER (kept) || ' provenance-bearing evidence ref(s).' AS summary
 FROM k""",
)
def correlate_full(spark, sf_dir):
    """A whole correlation: budgets, hits, edges, findings and summary, with what was left out."""
    row = C.correlate(corpus.evidence(spark, sf_dir), FULL)
    place = F.array(*[F.lit(d) for d in _FULL_DOMAINS])
    over = F.array_sort(F.transform("left_out", lambda o: F.struct(F.array_position(place, o["domain_id"]).alias("p"), o["references"].alias("r"), o["tokens"].alias("t"))))
    kept = F.filter("delegations", lambda d: d["package_count"] > 0)
    return row.select(
        "status", "packages", F.aggregate(kept, F.lit(0).cast("long"), lambda s, d: s + d["estimated_tokens"]).alias("tokens_kept"),
        F.array_join(F.flatten(F.transform(over, lambda o: o["r"])), ",").alias("left_out"), F.aggregate(over, F.lit(0).cast("long"), lambda s, o: s + o["t"]).alias("tokens_left_out"),
        F.size("edges").cast("long").alias("edges"), F.size(F.filter("findings", lambda f: f["classification"] == "missing_evidence")).cast("long").alias("missing_evidence"), "summary",
    )


@query(
    "edges_explicit_else_implied",
    f"""WITH {_INFERRED}, t AS (SELECT conv_id, turn, question, list_transform(found, lambda x: x.d) AS found FROM inferred),
 nxt AS (SELECT conv_id, turn, found[1] AS s, lead(found[1]) OVER (PARTITION BY conv_id ORDER BY turn, question) AS t FROM t),
 ex AS (SELECT DISTINCT conv_id, s AS source_domain_id, t AS target_domain_id, 'handoff' AS relation_type, 'explicit' AS origin FROM nxt WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t),
 doms AS (SELECT DISTINCT conv_id, unnest(found) AS d FROM t),
 opening AS (SELECT conv_id, arg_min(question, (turn, question)) AS question FROM t GROUP BY conv_id),
 im AS (SELECT a.conv_id, a.d AS source_domain_id, b.d AS target_domain_id, CASE WHEN contains(lower(question), 'handoff') THEN 'handoff' WHEN contains(lower(question), 'ownership') OR contains(lower(question), 'case') THEN 'case-reference'
   WHEN contains(lower(question), 'delegate') THEN 'delegates-to' ELSE 'integration-correlation' END AS relation_type, 'implied' AS origin FROM doms a JOIN doms b ON a.conv_id = b.conv_id AND a.d <> b.d JOIN opening o ON o.conv_id = a.conv_id
   WHERE a.conv_id NOT IN (SELECT conv_id FROM ex))
 SELECT * FROM ex UNION ALL SELECT * FROM im""",
)
def edges_explicit_else_implied(spark, sf_dir):
    """Conversations as requests: consecutive turns about two domains state an edge, other conversations imply theirs."""
    turns = _questions(spark, sf_dir).select("conv_id", "turn", "question", router.inferred_domains(F.col("question")).alias("found"))
    first = F.get("found", F.lit(0))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", first.alias("d"), "found"))).alias("t"))
    steps = F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda x, i: F.struct(F.get(F.col("t.d"), i).alias("source_domain_id"), x["d"].alias("target_domain_id"), F.get(F.col("t.turn"), i).alias("turn")))
    explicit = per.select(F.col("conv_id").alias("request_id"), F.inline(steps)).where("source_domain_id is not null and source_domain_id <> target_domain_id").withColumn("relation_type", F.lit("handoff"))
    requests = per.select(F.col("conv_id").alias("request_id"), F.get(F.col("t.question"), F.lit(0)).alias("question"), F.array_distinct(F.flatten(F.col("t.found"))).alias("domain_ids"))
    return C.request_edges(explicit, requests, ["turn"]).withColumnRenamed("request_id", "conv_id")
