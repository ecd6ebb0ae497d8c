"""Domain-scoped search tools."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import text as T
from attesta.operators.filters import RetrievalFilters
from attesta.plans import search_tools as ST
from attesta.sources import corpus

INTERNAL = RetrievalFilters(principal_acl_scopes=("internal",))


def _chunks(spark, sf_dir):
    return corpus.evidence(spark, sf_dir)


def _hits(df):
    return df.select("chunk_id", F.round("lexical_score", 8).alias("lexical_score"), F.round("score", 8).alias("score"))


_EXACT = f"""hay AS (SELECT chunk_id, ordinal, lower(text || ' ' || locator || ' ' || source_uri || '    repo src part_' || k || '.py part_' || k || ' ' || array_to_string(regexp_extract_all(text, '(?m)^\\s*(?:class|def)\\s+(\\w+)', 1), ' ')) AS hay
 FROM (SELECT *, replace(chunk_id, 'code-', '') AS k FROM ({S.CODE})) WHERE acl_scope = 'internal'),
 found AS (SELECT *, 1.0::DOUBLE AS lexical_score, CASE WHEN contains(hay, 'return load_7') THEN 1.0::DOUBLE ELSE greatest(0.5, 1.0)::DOUBLE END AS score FROM hay WHERE contains(hay, 'return') AND contains(hay, 'load_7'))"""


@query("exact_search", f"WITH {_EXACT} SELECT chunk_id, lexical_score, score FROM found ORDER BY score DESC, ordinal, chunk_id LIMIT 25")
def exact_search(spark, sf_dir):
    return _hits(ST.search(_chunks(spark, sf_dir), "code_exact", ST.SearchRequest("return load_7", limit=25, filters=INTERNAL)))


@query(
    "symbol_search",
    f"""WITH c AS (SELECT *, replace(chunk_id, 'code-', '') AS k FROM ({S.CODE}) WHERE acl_scope = 'internal'), s AS (SELECT *, list_transform(list_distinct(list_concat(['repo', 'src', 'part_' || k || '.py', 'part_' || k], regexp_extract_all(text, '(?m)^\\s*(?:class|def)\\s+(\\w+)', 1))), lambda x: lower(x)) AS symbols FROM c),
 h AS (SELECT *, lower(text || ' ' || locator || ' ' || source_uri) || ' ' || array_to_string(symbols, ' ') AS hay, lower(locator || ' ' || source_uri) || ' ' || array_to_string(symbols, ' ') AS names FROM s)
 SELECT chunk_id, contains(names, 'size_9')::INT::DOUBLE AS lexical_score, CASE WHEN list_contains(symbols, 'size_9') THEN 1.0::DOUBLE ELSE greatest(contains(names, 'size_9')::INT::DOUBLE, 0.75) END AS score FROM h WHERE contains(hay, 'size_9') AND (contains(lower(source_uri), 'repo/src') OR contains(locator, 'repo/src'))
 ORDER BY score DESC, ordinal, chunk_id LIMIT 30""",
)
def symbol_search(spark, sf_dir):
    return _hits(ST.search(_chunks(spark, sf_dir), "code_symbols", ST.SearchRequest("Size_9", path="./repo/src", limit=30, filters=INTERNAL)))


@query(
    "log_search",
    f"""WITH l AS (SELECT *, regexp_extract(text, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}})', 1)::TIMESTAMP AS t, regexp_extract(text, 'correlation_id=([A-Za-z0-9._:-]+)', 1) AS corr FROM ({S.LOGS}) WHERE acl_scope = 'internal')
 SELECT chunk_id, (contains(lower(text || ' ' || locator || ' ' || source_uri), 'error')::INT + contains(lower(text || ' ' || locator || ' ' || source_uri), 'handled')::INT)::DOUBLE / 2 AS lexical_score,
  greatest((contains(lower(text || ' ' || locator || ' ' || source_uri), 'error')::INT + contains(lower(text || ' ' || locator || ' ' || source_uri), 'handled')::INT)::DOUBLE / 2, 0.75) AS score
 FROM l WHERE corr IN ('corr-8', 'corr-46', 'corr-7') AND t >= TIMESTAMP '2024-01-02 00:00:00' ORDER BY score DESC, ordinal, chunk_id LIMIT 20""",
)
def log_search(spark, sf_dir):
    request = ST.SearchRequest("error, handled", correlation_ids=("CORR-8", "corr-46", "corr-7"), since=datetime(2024, 1, 2), limit=20, filters=INTERNAL)
    return _hits(ST.search(_chunks(spark, sf_dir), "logs", request))


def _semantic_sql(kind: str, words: str, table: str) -> str:
    return f"""WITH s AS (SELECT chunk_id, ordinal, {S.lexical('text', T.query_terms(words))} AS lexical_score FROM ({table}) WHERE acl_scope = 'internal')
 SELECT chunk_id, round(lexical_score, 8) AS lexical_score, round(lexical_score * 0.25, 8) AS score FROM s ORDER BY lexical_score DESC, ordinal, chunk_id LIMIT 10"""


@query(
    "docs_search",
    f"""WITH {S.SIMILARITY}, s AS (SELECT chunk_id, ordinal, {S.lexical('text', T.query_terms('verification of the src3'))} AS lexical_score FROM ({S.PROSE}) WHERE acl_scope = 'internal'),
 h AS (SELECT chunk_id, ordinal, lexical_score, coalesce(semantic_score, 0) AS semantic_score, {S.HYBRID} AS score FROM s LEFT JOIN sim USING (chunk_id))
 SELECT chunk_id, round(lexical_score, 8) AS lexical_score, round(semantic_score, 6) AS semantic_score, round(score, 6) AS score FROM h ORDER BY h.score DESC, ordinal, chunk_id LIMIT 10""",
)
def docs_search(spark, sf_dir):
    """Lexical and vector scores together, over the documents that have a vector and those that have none."""
    request = ST.SearchRequest("verification of the src3", filters=INTERNAL)
    found = ST.search(_chunks(spark, sf_dir), "docs", request, corpus.document_vectors(spark, sf_dir), S.QUERY_VECTOR)
    return found.select("chunk_id", F.round("lexical_score", 8).alias("lexical_score"), F.round("semantic_score", 6).alias("semantic_score"), F.round("score", 6).alias("score"))


@query("schema_search", _semantic_sql("schema", "table nation_7 varchar", S.SCHEMAS))
def schema_search(spark, sf_dir):
    return _hits(ST.search(_chunks(spark, sf_dir), "schema", ST.SearchRequest("table nation_7 varchar", filters=INTERNAL)))


@query("query_output_search", _semantic_sql("query-output", "0 rows status", S.OUTPUTS))
def query_output_search(spark, sf_dir):
    return _hits(ST.search(_chunks(spark, sf_dir), "query_outputs", ST.SearchRequest("0 rows status", filters=INTERNAL)))


@query(
    "batch_correlation",
    f"""WITH {S.EVIDENCE}, {S.SIMILARITY}, s AS (SELECT chunk_id, ordinal, {S.lexical('text', T.query_terms('req-17 req-16 req-18'))} AS lexical_score FROM evidence WHERE domain_id = 'encargos_sigef' AND system_id IN ('sys-1', 'sys-2')
   AND source_type IN ('document', 'log', 'code', 'schema', 'query-output')), h AS (SELECT chunk_id, ordinal, lexical_score, {S.HYBRID} AS score FROM s LEFT JOIN sim USING (chunk_id))
 SELECT chunk_id, round(lexical_score, 8) AS lexical_score, round(score, 6) AS score FROM h ORDER BY h.score DESC, ordinal, chunk_id LIMIT 10""",
)
def batch_correlation(spark, sf_dir):
    from attesta.plans import profiles

    systems = profiles.expand_systems(["batch", "LEDGER"], {"batch": ("sys-1",), "ledger": ("sys-2", "sys-1")})
    request = ST.SearchRequest(profiles.batch_query("req-17", "req-16", "req-18"), filters=RetrievalFilters(principal_domain_id="encargos_sigef", system_ids=systems))
    found = ST.search(_chunks(spark, sf_dir), "domain_evidence", request, corpus.document_vectors(spark, sf_dir), S.QUERY_VECTOR)
    return found.select("chunk_id", F.round("lexical_score", 8).alias("lexical_score"), F.round("score", 6).alias("score"))


@query(
    "search_packages",
    f"WITH {_EXACT}, top AS (SELECT * FROM found ORDER BY score DESC, ordinal, chunk_id LIMIT 25) SELECT 'pkg_' || left(sha256('pkg' || chr(0) || 'return load_7' || chr(0) || 'code_exact' || chr(0) || replace(chunk_id, 'code-', 'codev-') || chr(0)), 24) AS package_id, replace(chunk_id, 'code-', 'codev-') AS source_version_id, score FROM top",
)
def search_packages(spark, sf_dir):
    packs = ST.search_packages(_chunks(spark, sf_dir), "code_exact", ST.SearchRequest("return load_7", limit=25, filters=INTERNAL))
    return packs.select("package_id", "source_version_id", "score")


@query(
    "hit_enrichment",
    f"""WITH c AS (SELECT *, regexp_extract(text, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}})', 1) AS t FROM ({S.LOGS}))
 SELECT chunk_id, regexp_extract(text, 'correlation_id=([A-Za-z0-9._:-]+)', 1) AS correlation, replace(chunk_id, 'log-', 'req-') AS request, t::TIMESTAMP AS first_ts, greatest(1, (length(text) + 3) // 4)::BIGINT AS estimated_tokens, strlen(text)::BIGINT AS estimated_bytes,
  array_to_string(list_sort(['logs', string_split(source_uri, '/')[2], replace(string_split(source_uri, '/')[2], '.log', '')]), ',') AS symbols FROM c""",
)
def hit_enrichment(spark, sf_dir):
    rows = ST.enrich(corpus.logs(spark, sf_dir))
    return rows.select(
        "chunk_id", F.array_join("correlation_ids", ",").alias("correlation"), F.array_join("request_ids", ",").alias("request"), F.get("timestamps", F.lit(0)).cast("timestamp_ntz").alias("first_ts"),
        "estimated_tokens", "estimated_bytes", F.array_join("symbol_names", ",").alias("symbols"),
    )


_RETRIEVED = f"""top AS (SELECT *, 1.0::DOUBLE AS score FROM ({S.CODE}) WHERE acl_scope = 'internal' AND contains(lower(text || locator), 'size_9') ORDER BY ordinal, chunk_id LIMIT 30)"""


@query(
    "package_findings",
    f"""WITH {_RETRIEVED} SELECT 'fact' AS classification, 'Criminal-domain evidence matched: import catalog' AS statement, 1.0::DOUBLE AS confidence, source_id || ':' || locator AS provenance_ref,
  'eref_' || left(sha256('eref' || chr(0) || source_id || chr(0) || source_version_id || chr(0) || locator || chr(0) || 'code_exact' || chr(0) || 'size_9' || chr(0)), 24) AS reference_id FROM top""",
)
def package_findings(spark, sf_dir):
    """An identifier-like query takes the exact path; every reference becomes a fact."""
    packs = ST.retrieve(_chunks(spark, sf_dir), ST.SearchRequest("size_9", limit=30, filters=INTERNAL))
    return ST.package_findings(packs, "Criminal-domain")
