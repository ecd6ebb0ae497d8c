"""Identifiers, timestamps, frames, objects and endpoints found in evidence text."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import extract
from attesta.functions import text as T
from attesta.operators import joins
from attesta.sources import corpus


@query(
    "correlation_ids",
    rf"""SELECT chunk_id, array_to_string(list_transform(regexp_extract_all(text, '(?i)(?:correlation[_-]?id|request[_-]?id|trace[_-]?id|session[_-]?id)\s*[:=]\s*([A-Za-z0-9._:-]+)', 1), lambda x: x), ',') AS ids
 FROM ({S.LOGS})""",
)
def correlation_ids(spark, sf_dir):
    return corpus.logs(spark, sf_dir).select("chunk_id", F.array_join(extract.correlation_ids(F.col("text")), ",").alias("ids"))


@query("log_ids_typed", "SELECT 'log-' || event_id AS chunk_id, 'corr-' || user_id AS correlation, 'req-' || event_id AS request, '' AS session FROM events")
def log_ids_typed(spark, sf_dir):
    logs = corpus.logs(spark, sf_dir)
    return logs.select("chunk_id", *[F.array_join(extract.typed_ids(F.col("text"), k), ",").alias(k) for k in ("correlation", "request", "session")])


@query(
    "timestamps_in_text",
    rf"""SELECT chunk_id, len(ts)::BIGINT AS n, ts[1]::TIMESTAMP AS first_ts FROM (SELECT chunk_id, regexp_extract_all(text, '\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}') AS ts FROM ({S.LOGS} UNION ALL {S.EXPORTS} UNION ALL {S.OUTPUTS}))""",
)
def timestamps_in_text(spark, sf_dir):
    rows = corpus.logs(spark, sf_dir).unionByName(corpus.exports(spark, sf_dir)).unionByName(corpus.query_outputs(spark, sf_dir))
    found = rows.select("chunk_id", extract.timestamps(F.col("text")).alias("ts"))
    return found.select("chunk_id", F.size("ts").cast("long").alias("n"), F.get("ts", F.lit(0)).cast("timestamp_ntz").alias("first_ts"))


@query(
    "stack_frames",
    "SELECT 'log-' || event_id AS chunk_id, 'src/part_' || json_extract_string(props, '$.k') || '.py' AS path, json_extract_string(props, '$.k')::BIGINT AS line FROM events WHERE event_type = 'error'",
)
def stack_frames(spark, sf_dir):
    frames = corpus.logs(spark, sf_dir).select("chunk_id", F.inline(extract.stack_frames(F.col("text"))))
    return frames.select("chunk_id", "path", F.col("line").cast("long").alias("line"))


@query(
    "evidence_signals",
    rf"""WITH {S.EVIDENCE} SELECT chunk_id, regexp_matches(text, '(?i)\b(ERROR|FATAL|EXCEPTION|TRACEBACK|FAIL(?:ED|URE)?)\b') AS has_error, regexp_matches(text, '(?i)\b0\s+rows?\b|\bno rows?\b') AS zero_rows FROM evidence""",
)
def evidence_signals(spark, sf_dir):
    rows = corpus.evidence(spark, sf_dir)
    return rows.select("chunk_id", extract.has_error(F.col("text")).alias("has_error"), extract.has_zero_rows(F.col("text")).alias("zero_rows"))


@query(
    "schema_objects",
    rf"""SELECT chunk_id, array_to_string(list_concat(
   regexp_extract_all(text, '(?i)\b(?:CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE)\s+(?:TABLE|INDEX|VIEW|FUNCTION|PROC(?:EDURE)?)?\s*(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z0-9_.]+)', 1),
   list_filter(regexp_extract_all(text, '\b([A-Za-z0-9_]+)\s*\(', 1), lambda n: n NOT LIKE 'supplier%')), ',') AS objects FROM ({S.SCHEMAS})""",
)
def schema_objects(spark, sf_dir):
    return corpus.schemas(spark, sf_dir).select("chunk_id", F.array_join(extract.schema_objects(F.col("text")), ",").alias("objects"))


_EP = r"""'\b(?:https?://[^\s"'']+|/[A-Za-z0-9_./-]+|\b[A-Za-z0-9_.-]+#[A-Za-z0-9_.-]+)\b'"""


@query(
    "endpoints",
    f"SELECT page_id, len(list_distinct(e))::BIGINT AS n, array_to_string(list_sort(list_distinct(e)), ' ') AS endpoints FROM (SELECT page_id, regexp_extract_all(regexp_replace(url || ' ' || replace(html, '/', ' x/'), '[^ -~]', '', 'g'), {_EP}) AS e FROM pages)",
)
def endpoints(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    # The SQL engine's word boundary is ASCII only, so both sides read the ASCII part of the page.
    ascii_page = F.regexp_replace(F.concat("url", F.lit(" "), F.replace(F.col("html"), F.lit("/"), F.lit(" x/"))), "[^ -~]", "")
    found = pages.select("page_id", extract.endpoints(ascii_page).alias("e"))
    return found.select("page_id", F.size("e").cast("long").alias("n"), F.array_join(F.sort_array("e"), " ").alias("endpoints"))


@query(
    "symbol_names",
    rf"""SELECT chunk_id, array_to_string(list_sort(list_distinct(list_concat(['repo', 'src', 'part_' || k || '.py', 'part_' || k],
   regexp_extract_all(text, '(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(text, '(?m)^\s*(?:async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 1)))), ',') AS symbols
 FROM (SELECT *, replace(chunk_id, 'code-', '') AS k FROM ({S.CODE}))
 UNION ALL SELECT chunk_id, array_to_string(list_sort(list_distinct(list_concat(['db', 'supplier_' || k || '.sql', 'supplier_' || k],
   regexp_extract_all(text, '(?i)\b(?:create\s+(?:table|view|index)|alter\s+table|insert\s+into|update|from|join)\s+([A-Za-z_][A-Za-z0-9_\.]*)', 1)))), ',') FROM (SELECT *, replace(chunk_id, 'ddl-', '') AS k FROM ({S.SCHEMAS}))""",
)
def symbol_names(spark, sf_dir):
    rows = corpus.code(spark, sf_dir).unionByName(corpus.schemas(spark, sf_dir))
    return rows.select("chunk_id", F.array_join(extract.symbol_names(F.col("text"), F.col("source_uri")), ",").alias("symbols"))


@query(
    "frame_code_join",
    f"""SELECT 'log-' || e.event_id AS log_chunk, 'code-' || p.p_partkey AS code_chunk, 'src/part_' || p.p_partkey || '.py' AS path FROM events e JOIN part p ON json_extract_string(e.props, '$.k')::BIGINT = p.p_partkey WHERE e.event_type = 'error'""",
)
def frame_code_join(spark, sf_dir):
    frames = corpus.logs(spark, sf_dir).select(F.col("chunk_id").alias("log_chunk"), F.inline(extract.stack_frames(F.col("text"))))
    code = corpus.code(spark, sf_dir).select(F.col("chunk_id").alias("code_chunk"), "locator")
    return joins.frames_to_code(frames, code).select("log_chunk", "code_chunk", "path")


@query(
    "reference_statements",
    f"WITH {S.EVIDENCE} SELECT chunk_id, 'eref_' || left(sha256(source_id || chr(0) || source_version_id || chr(0) || locator || chr(0) || 'log-observation' || chr(0) || 'observed' || chr(0)), 24) AS reference_id, trim(regexp_replace(string_split(text, chr(10))[1], '\\r$', '')) AS statement FROM evidence",
)
def reference_statements(spark, sf_dir):
    from attesta.plans.audit import reference_id

    rows = corpus.evidence(spark, sf_dir)
    return rows.select("chunk_id", reference_id("log-observation", "observed").alias("reference_id"), T.first_line(F.col("text")).alias("statement"))


@query(
    "bounded_outputs",
    """SELECT doc_id, least(n, 8)::BIGINT AS row_count, n > 8 OR strlen(kept) > 1500 AS truncated,
  CASE WHEN strlen(kept) > 1500 OR (n > 8 AND strlen(kept) > 1496) THEN 'cut' ELSE sha256(kept) END AS content
 FROM (SELECT doc_id, len(lines) AS n, CASE WHEN len(lines) > 8 THEN array_to_string(lines[1:8], chr(10)) ELSE text END AS kept
   FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents))""",
)
def bounded_outputs(spark, sf_dir):
    from attesta.plans import diagnostics

    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("stdout"), F.lit("text").alias("output_format"))
    bounded = diagnostics.bound_outputs(docs, max_rows=8, max_bytes=1500)
    cut = F.col("truncated") & (F.octet_length("stdout") > 1496)
    return bounded.select("doc_id", "row_count", "truncated", F.when(cut, F.lit("cut")).otherwise(F.sha2("stdout", 256)).alias("content"))
