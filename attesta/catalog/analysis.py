"""Failure audit over the whole evidence corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import text as T
from attesta.operators import code_index
from attesta.plans import audit as A
from attesta.sources import corpus

REQUEST = A.AuditRequest("error handled in src/part_8.py catalog", scope="orders", symptoms=("0 rows", "supplier_9"))
_TERMS = T.query_terms(REQUEST.search_terms)
_HITS = f"""{S.EVIDENCE}, hits AS (SELECT * FROM (SELECT *, {S.lexical('text', _TERMS)} AS lex, row_number() OVER (PARTITION BY source_type ORDER BY {S.lexical('text', _TERMS)} DESC, ordinal, chunk_id) AS rank
 FROM evidence WHERE acl_scope = 'internal') WHERE rank <= 24)"""
_Z = "chr(0)"


def _eref(role: str, tag: str) -> str:
    return f"'eref_' || left(sha256(source_id || {_Z} || source_version_id || {_Z} || locator || {_Z} || '{role}' || {_Z} || '{tag}' || {_Z}), 24)"


def _hits(spark, sf_dir):
    return A.audit_hits(corpus.evidence(spark, sf_dir), REQUEST)


@query(
    "audit_hits_by_type",
    f"""WITH {S.EVIDENCE}, {S.SIMILARITY}, s AS (SELECT source_type, chunk_id, ordinal, {S.lexical('text', _TERMS)} AS lexical_score FROM evidence WHERE acl_scope = 'internal'),
 h AS (SELECT source_type, chunk_id, ordinal, {S.HYBRID} AS score FROM s LEFT JOIN sim USING (chunk_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY score DESC, ordinal, chunk_id) AS rank FROM h)
 SELECT source_type, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 24""",
)
def audit_hits_by_type(spark, sf_dir):
    """Best hits of every source type by lexical and vector score."""
    found = A.audit_hits(corpus.evidence(spark, sf_dir), REQUEST, embeddings=corpus.document_vectors(spark, sf_dir), query_vector=S.QUERY_VECTOR)
    return found.select("source_type", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _flat(found):
    return found.select("classification", "statement", "confidence", "verification_status", F.array_join("references", ",").alias("refs"))


_CID = r"regexp_extract_all(text, '(?i)(?:correlation[_-]?id|request[_-]?id|trace[_-]?id|session[_-]?id)\s*[:=]\s*([A-Za-z0-9._:-]+)', 1)"
_LOG_FINDINGS = rf"""logs AS (SELECT *, regexp_matches(text, '(?i)\b(ERROR|FATAL|EXCEPTION|TRACEBACK|FAIL(?:ED|URE)?)\b') AS bad, {_CID} AS cids FROM hits WHERE source_type = 'log'),
 lf AS (SELECT 'fact' AS classification, 'Application logs contain a failure signal in ' || string_agg(DISTINCT locator, ', ' ORDER BY locator) || '.' AS statement, 0.98::DOUBLE AS confidence, 'observed' AS verification_status,
   string_agg(DISTINCT {_eref('log-observation', 'observed')}, ',' ORDER BY {_eref('log-observation', 'observed')}) AS refs FROM logs WHERE bad HAVING count(*) > 0
  UNION ALL SELECT 'fact', 'Correlation identifiers were present in the logs: ' || (SELECT string_agg(c, ', ' ORDER BY c) FROM (SELECT DISTINCT unnest(cids) AS c FROM logs)) || '.', 0.95, 'observed',
   string_agg(DISTINCT {_eref('correlation-observation', 'observed')}, ',' ORDER BY {_eref('correlation-observation', 'observed')}) FROM logs WHERE len(cids) > 0 HAVING count(*) > 0)"""


@query("audit_log_findings", f"WITH {_HITS}, {_LOG_FINDINGS} SELECT * FROM lf")
def audit_log_findings(spark, sf_dir):
    return _flat(A.analyze_logs(_hits(spark, sf_dir), REQUEST))


_CSV_FINDINGS = f"""cf AS (SELECT 'fact' AS classification, 'Splunk export at ' || locator || ' contains 1 event row(s) with columns _time, host, message. Correlation IDs observed: ' || regexp_extract(text, 'correlation_id=([A-Za-z0-9._:-]+)', 1) || '.' AS statement,
  0.9::DOUBLE AS confidence, 'observed' AS verification_status, {_eref('splunk-export', 'observed')} AS refs FROM hits WHERE source_type = 'splunk-csv')"""


@query("audit_export_findings", f"WITH {_HITS}, {_CSV_FINDINGS} SELECT * FROM cf")
def audit_export_findings(spark, sf_dir):
    return _flat(A.analyze_exports(_hits(spark, sf_dir), REQUEST))


def _with_symbols(hits):
    """Code hits with the qualified names they declare (at most 24 hits are indexed)."""
    code = hits.where("source_type = 'code'").select("source_version_id", "source_uri", F.col("text").alias("content"))
    symbols = code_index.declarations(code)
    names = symbols.groupBy("source_version_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "qualified_name")))["qualified_name"].alias("symbol_names"))
    return hits.join(names, "source_version_id", "left")


@query(
    "audit_code_findings",
    f"""WITH {_HITS}, s AS (SELECT *, 'Part' || replace(chunk_id, 'code-', '') AS c, regexp_extract_all(text, 'def\\s+(\\w+)', 1) AS f FROM hits WHERE source_type = 'code')
 SELECT 'fact' AS classification, 'Persistent code index resolves symbols ' || c || ', ' || c || '.' || f[1] || ', ' || c || '.' || f[2] || ' in ' || locator || '.' AS statement, 0.9::DOUBLE AS confidence, 'observed' AS verification_status, {_eref('code-symbol-index', 'observed')} AS refs FROM s""",
)
def audit_code_findings(spark, sf_dir):
    return _flat(A.analyze_code(_with_symbols(A.materialized_hits(corpus.evidence(spark, sf_dir), REQUEST)), REQUEST))


_SCHEMA_OBJ = r"""list_concat(regexp_extract_all(text, '(?i)\b(?:CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE)\s+(?:TABLE|INDEX|VIEW|FUNCTION|PROC(?:EDURE)?)?\s*(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z0-9_.]+)', 1), regexp_extract_all(text, '\b([A-Za-z0-9_]+)\s*\(', 1))"""
_SCHEMA_FINDINGS = f"""sf AS (SELECT 'fact' AS classification, 'Schema evidence identifies objects: ' || (SELECT string_agg(o, ', ' ORDER BY o) FROM (SELECT DISTINCT unnest({_SCHEMA_OBJ}) AS o FROM hits WHERE source_type = 'schema')) || '.' AS statement, 0.92::DOUBLE AS confidence, 'observed' AS verification_status,
   string_agg({_eref('schema-object', 'observed')}, ',' ORDER BY {_eref('schema-object', 'observed')}) AS refs FROM hits WHERE source_type = 'schema' HAVING count(*) > 0
  UNION ALL SELECT 'inference', 'Schema and query evidence are consistent with a data-access path rather than an isolated presentation-layer failure.', 0.7, 'inferred', string_agg({_eref('schema-query-consistency', 'supporting')}, ',' ORDER BY {_eref('schema-query-consistency', 'supporting')})
   FROM hits WHERE source_type = 'schema' HAVING bool_or(contains(lower(text), 'query')))"""


@query("audit_schema_findings", f"WITH {_HITS}, {_SCHEMA_FINDINGS} SELECT * FROM sf")
def audit_schema_findings(spark, sf_dir):
    return _flat(A.analyze_schemas(_hits(spark, sf_dir), REQUEST))


_OUT_FINDINGS = f"""qf AS (SELECT CASE WHEN contains(text, '0 rows') THEN 'missing_evidence' ELSE 'fact' END AS classification, 'Query output at ' || locator || CASE WHEN contains(text, '0 rows') THEN ' does not provide sufficient live data to confirm the database state.' ELSE ' contains 1 row(s) with explicit result evidence.' END AS statement,
  CASE WHEN contains(text, '0 rows') THEN 0.88 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN contains(text, '0 rows') THEN 'needs_live_verification' ELSE 'observed' END AS verification_status,
  CASE WHEN contains(text, '0 rows') THEN {_eref('query-output-gap', 'supporting')} ELSE {_eref('query-output', 'observed')} END AS refs FROM hits WHERE source_type = 'query-output')"""


@query("audit_query_output_findings", f"WITH {_HITS}, {_OUT_FINDINGS} SELECT * FROM qf")
def audit_query_output_findings(spark, sf_dir):
    return _flat(A.analyze_query_outputs(_hits(spark, sf_dir), REQUEST))


_DOC_FINDINGS = f"""df AS (SELECT 'fact' AS classification, 'Documentation at ' || locator || ' defines a controlled verification expectation.' AS statement, 0.84::DOUBLE AS confidence, 'observed' AS verification_status, {_eref('doc-verification', 'observed')} AS refs
 FROM hits WHERE source_type = 'document' AND regexp_matches(lower(text), 'verify|verification|on-prem|controlled|evidence'))"""


@query("audit_document_findings", f"WITH {_HITS}, {_DOC_FINDINGS} SELECT * FROM df")
def audit_document_findings(spark, sf_dir):
    return _flat(A.analyze_documents(_hits(spark, sf_dir), REQUEST))


_EP = r"""regexp_extract_all(text, '\b(?:https?://[^\s"\']+|/[A-Za-z0-9_./-]+|\b[A-Za-z0-9_.-]+#[A-Za-z0-9_.-]+)\b')""".replace("\\'", "''")
_INT_FINDINGS = f"""nf AS (SELECT 'fact' AS classification, 'Integration definitions expose endpoints or operations: ' || (SELECT string_agg(o, ', ' ORDER BY o) FROM (SELECT DISTINCT unnest({_EP}) AS o FROM hits WHERE source_type = 'integration')) || '.' AS statement, 0.82::DOUBLE AS confidence, 'observed' AS verification_status,
   string_agg({_eref('integration-definition', 'observed')}, ',' ORDER BY {_eref('integration-definition', 'observed')}) AS refs FROM hits WHERE source_type = 'integration' HAVING count(*) > 0)"""


@query("audit_integration_findings", f"WITH {_HITS}, {_INT_FINDINGS} SELECT * FROM nf")
def audit_integration_findings(spark, sf_dir):
    return _flat(A.analyze_integrations(_hits(spark, sf_dir), REQUEST))


_POINTS = """points AS (SELECT coalesce(try_cast(nullif(regexp_extract(text, '(\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}:\\d{2})', 1), '') AS TIMESTAMP), ingest_ts) AS ts, trim(regexp_replace(string_split(text, chr(10))[1], '\\r$', '')) AS statement, source_id, source_type, locator FROM hits)"""


@query("audit_timeline", f"WITH {_HITS}, {_POINTS} SELECT ts, statement, source_id, source_type, locator, 'event_' || left(sha256(source_id || ':' || locator || {_Z} || statement || {_Z}), 24) AS event_id FROM points")
def audit_timeline(spark, sf_dir):
    points = A.timeline(_hits(spark, sf_dir))
    return points.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), "statement", "source_id", "source_type", "locator", "event_id")


_ALL = f"""{_HITS}, {_LOG_FINDINGS}, {_CSV_FINDINGS}, {_SCHEMA_FINDINGS}, {_OUT_FINDINGS}, {_DOC_FINDINGS}, {_INT_FINDINGS}, {_POINTS},
 base AS (SELECT * FROM lf UNION ALL SELECT * FROM cf UNION ALL SELECT * FROM sf UNION ALL SELECT * FROM qf UNION ALL SELECT * FROM df UNION ALL SELECT * FROM nf),
 frames AS (SELECT DISTINCT l.path || ':' || l.line AS raw, c.locator, c.chunk_id FROM (SELECT regexp_extract(text, 'File "([^"]+)", line', 1) AS path, regexp_extract(text, 'line (\\d+)', 1) AS line FROM hits WHERE source_type = 'log' AND contains(text, 'File "')) l
   JOIN (SELECT * FROM hits WHERE source_type = 'code') c ON ends_with(string_split(c.locator, ':')[1], l.path)),
 derived AS (SELECT 'fact' AS classification FROM frames HAVING count(*) > 0 UNION ALL SELECT 'hypothesis' FROM frames HAVING count(*) > 0 AND (SELECT count(*) FROM lf WHERE contains(statement, 'failure signal')) > 0
   UNION ALL SELECT 'recommendation' FROM base WHERE classification = 'missing_evidence' HAVING count(*) > 0),
 everything AS (SELECT classification FROM base UNION ALL SELECT classification FROM derived)"""


def _whole(spark, sf_dir):
    return A.materialized_hits(corpus.evidence(spark, sf_dir), REQUEST)


@query("audit_finding_counts", f"WITH {_ALL} SELECT classification, count(*) AS n FROM everything GROUP BY classification")
def audit_finding_counts(spark, sf_dir):
    return A.class_counts(A.findings(_whole(spark, sf_dir), REQUEST))


@query(
    "audit_summary",
    f"""WITH {_ALL} SELECT 'Audit scope ''orders'' produced ' || count(*) FILTER (classification = 'fact') || ' fact finding(s), ' || count(*) FILTER (classification = 'hypothesis') || ' hypothesis finding(s), and '
  || count(*) FILTER (classification = 'missing_evidence') || ' missing-evidence finding(s).' AS summary FROM everything""",
)
def audit_summary(spark, sf_dir):
    found = A.findings(_whole(spark, sf_dir), REQUEST)
    return found.agg(A.executive_summary(found, REQUEST).alias("summary"))


@query(
    "audit_cross_source",
    f"""WITH {_ALL}, code_fact AS (SELECT 'Source code evidence matches the runtime stack frame(s) ' || string_agg(DISTINCT raw, ', ' ORDER BY raw) || '.' AS statement, string_agg(DISTINCT locator, ',' ORDER BY locator) AS provenance, string_agg(DISTINCT locator, ', ' ORDER BY locator) AS named FROM frames HAVING count(*) > 0),
 log_fact AS (SELECT string_agg(DISTINCT locator, ',' ORDER BY locator) AS provenance FROM logs WHERE bad HAVING count(*) > 0),
 schema_fact AS (SELECT string_agg(DISTINCT locator, ',' ORDER BY locator) AS provenance, string_agg(DISTINCT locator, ', ' ORDER BY locator) AS named FROM hits WHERE source_type = 'schema' HAVING count(*) > 0)
 SELECT 'fact' AS classification, statement, 0.96::DOUBLE AS confidence, provenance FROM code_fact
 UNION ALL SELECT 'hypothesis', 'The runtime failure appears to originate in ' || c.named || '.' || coalesce(' The schema evidence suggests it surfaces where records of ' || s.named || ' are expected.', ''), 0.74, concat_ws(',', l.provenance, c.provenance, s.provenance)
  FROM code_fact c CROSS JOIN log_fact l LEFT JOIN schema_fact s ON true
 UNION ALL SELECT 'recommendation', '{A.RECOMMENDATION}', 0.91, (SELECT replace(replace(statement, 'Query output at ', ''), ' does not provide sufficient live data to confirm the database state.', '') FROM qf WHERE classification = 'missing_evidence' ORDER BY statement LIMIT 1)
  FROM qf WHERE classification = 'missing_evidence' HAVING count(*) > 0""",
)
def audit_cross_source(spark, sf_dir):
    hits = _whole(spark, sf_dir)
    derived = A.cross_source_findings(A.observations(hits, REQUEST), hits, REQUEST)
    return derived.select("classification", "statement", "confidence", F.array_join("provenance", ",").alias("provenance"))


@query(
    "audit_causal_chains",
    f"""WITH {_HITS}, {_POINTS} SELECT 'Timeline anchors are ' || string_agg(source_id || ':' || locator, ' -> ' ORDER BY ts, source_id, locator) AS chain FROM (SELECT * FROM points ORDER BY ts, source_id, locator LIMIT 4)""",
)
def audit_causal_chains(spark, sf_dir):
    hits = A.materialized_hits(corpus.evidence(spark, sf_dir), REQUEST)
    return A.causal_chains(A.observations(hits, REQUEST), A.timeline(hits)).where("kind = 'timeline'").select("chain")


@query("audit_source_types", f"WITH {S.EVIDENCE} SELECT DISTINCT source_type FROM evidence")
def audit_source_types(spark, sf_dir):
    return A.source_types(corpus.evidence(spark, sf_dir))


@query("audit_report")
def audit_report(spark, sf_dir):
    """Complete report row (JSON and Markdown) of one audit over the corpus."""
    return A.report(A.materialized_hits(corpus.evidence(spark, sf_dir), REQUEST), REQUEST).select("report_id", "executive_summary", F.size("finding_ids").cast("long").alias("findings"), F.size("timeline_event_ids").cast("long").alias("events"), F.length("human_report").cast("long").alias("report_chars"))


@query(
    "scoped_domain_audit",
    f"""WITH {S.EVIDENCE}, hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY {S.lexical('text', T.query_terms('error handled sys-1 sys-3'))} DESC, ordinal, chunk_id) AS rank FROM evidence
   WHERE acl_scope = 'internal' AND domain_id = 'contraordenacional' AND system_id IN ('sys-1', 'sys-3') AND source_type = 'log') WHERE rank <= 24), {_LOG_FINDINGS}
 SELECT classification, statement, confidence, verification_status, refs FROM lf""",
)
def scoped_domain_audit(spark, sf_dir):
    from attesta.operators.filters import RetrievalFilters, compile_filters

    request = A.AuditRequest("error handled", systems=("sys-1", "sys-3"), source_types=("log",))
    confined = corpus.evidence(spark, sf_dir).where(compile_filters(RetrievalFilters(principal_acl_scopes=("internal",), principal_domain_id="contraordenacional")))
    return _flat(A.analyze_logs(A.audit_hits(confined, request), request))
