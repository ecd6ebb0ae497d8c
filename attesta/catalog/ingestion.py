"""Parsing, chunking, redaction and ingest plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import extract, redact
from attesta.functions import text as T
from attesta.plans import ingest as I
from attesta.sources import blocks, channels, corpus, files

_BLOCK_SQL = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS ordinal, line_start, line_end, sha256(text) AS text_hash FROM blocks"


def _blocks(spark, sf_dir, cut):
    docs = corpus.table(spark, sf_dir, "documents")
    rows = blocks.explode_blocks(docs, cut(F.col("text")), ["doc_id"])
    return rows.select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), F.sha2("text", 256).alias("text_hash")
    )


@query("chunk_greedy_900", f"WITH RECURSIVE {S.chunker('documents', 'doc_id', 900, False)} {_BLOCK_SQL}")
def chunk_greedy_900(spark, sf_dir):
    return _blocks(spark, sf_dir, blocks.chunk_blocks)


@query("chunk_line_blocks_1200", f"WITH RECURSIVE {S.chunker('documents', 'doc_id', 1200, True)} {_BLOCK_SQL}")
def chunk_line_blocks_1200(spark, sf_dir):
    return _blocks(spark, sf_dir, blocks.line_blocks)


@query(
    "line_explode",
    "SELECT doc_id, i - 1 AS line, sha256(parts[i]) AS line_hash FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)",
)
def line_explode(spark, sf_dir):
    lines = corpus.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.splitlines(F.col("text"))).alias("line", "text"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2("text", 256).alias("line_hash"))


@query(
    "csv_rows",
    f"""SELECT chunk_id, 1::BIGINT AS n_rows, '_time: ' || c[1] || chr(10) || 'host: ' || c[2] || chr(10) || 'message: ' || c[3] AS text, split_part(source_uri, '/', 2) || '#row-2' AS locator, '["_time"]' AS timestamp_fields
 FROM (SELECT *, string_split(string_split(text, chr(10))[2], ',') AS c FROM ({S.EXPORTS}))""",
)
def csv_rows(spark, sf_dir):
    exports = corpus.exports(spark, sf_dir)
    parsed = exports.select("chunk_id", files.parse_blocks(F.col("source_uri"), F.col("text").cast("binary"))["blocks"].alias("b"))
    first = F.col("b")[0]
    return parsed.select("chunk_id", F.size("b").cast("long").alias("n_rows"), first["text"].alias("text"), first["locator"].alias("locator"), first["metadata"]["timestamp_fields"].alias("timestamp_fields"))


@query(
    "query_table_rows",
    f"""SELECT chunk_id, CASE WHEN contains(text, '0 rows') THEN 0 ELSE 1 END::BIGINT AS n_rows, CASE WHEN contains(text, '0 rows') THEN NULL ELSE string_split(string_split(text, chr(10))[3], ' | ')[2] END AS status FROM ({S.OUTPUTS})""",
)
def query_table_rows(spark, sf_dir):
    rows = extract.query_table_rows(F.col("text"))
    parsed = corpus.query_outputs(spark, sf_dir).select("chunk_id", rows.alias("rows"))
    return parsed.select("chunk_id", F.size("rows").cast("long").alias("n_rows"), F.get("rows", F.lit(0))["status"].alias("status"))


@query(
    "redact_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(p, 'src7', '[redacted]'),
   '(?i)\b(api[-_ ]?key|access[-_ ]?token|refresh[-_ ]?token|client[-_ ]?secret|private[-_ ]?key|password|passwd|secret|token|credential)\b(\s*[:=]\s*)([^\s,"'']+)', '\1\2[redacted]', 'g'),
   '(?i)\bAuthorization(\s*:\s*Bearer\s+)([^\s,"'']+)', 'Authorization\1[redacted]', 'g'),
   '(?i)\bhttps?://(?:[^/\s:@]+(?::[^/\s:@]+)?@)?(?:(?:localhost|127(?:\.\d{1,3}){3}|10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})|(?:[A-Za-z0-9-]+\.)*(?:internal|local|corp|lan))(?::\d+)?(?:/[^\s"'']*)?', '[redacted]', 'g') AS redacted
 FROM (SELECT doc_id, 'password=' || source || ' Authorization: Bearer ' || lang || ' http://10.0.0.' || (doc_id % 250) || '/x ' || text AS p FROM documents)""",
)
def redact_text(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    text = corpus.text_of("password=", F.col("source"), " Authorization: Bearer ", F.col("lang"), " http://10.0.0.", F.col("doc_id") % 250, "/x ", F.col("text"))
    return docs.select("doc_id", redact.redact_text(text, F.array(F.lit("src7"), F.lit(""))).alias("redacted"))


@query(
    "redact_metadata",
    "SELECT page_id, '[redacted]' AS page_url, '[redacted]' AS api_token, 'page-' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN url || ',t-' || page_id ELSE url || ',t-' || page_id END AS secrets FROM pages",
)
def redact_metadata(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    meta = F.create_map(F.lit("page_URL"), F.col("url"), F.lit("api_token"), corpus.text_of("t-", F.col("page_id")), F.lit("title"), corpus.text_of("page-", F.col("page_id")))
    clean = redact.redact_metadata(meta)
    return pages.select(
        "page_id", clean["page_URL"].alias("page_url"), clean["api_token"].alias("api_token"), clean["title"].alias("title"), F.array_join(redact.sensitive_values(meta), ",").alias("secrets")
    )


_ROOM = "'room-' || conv_id"
_MSG = "'m' || turn"


@query(
    "channel_jobs",
    f"""WITH m AS (SELECT {_ROOM} AS c, {_MSG} AS m, text, role FROM conversations), j AS (
   SELECT c, m, 'webex://rooms/' || c || '/messages/' || m || '#message' AS source_uri, c || ':' || m || ':message' AS k, text AS content, 'document' AS source_type, 'webex-message' AS hint FROM m
   UNION ALL SELECT c, m, 'webex://rooms/' || c || '/messages/' || m || '/attachments/' || role || '.log', c || ':' || m || ':' || role || '.log', role, 'log', 'webex-attachment' FROM m),
 s AS (SELECT *, 'src_' || left(sha256('webex' || chr(0) || k || chr(0) || chr(0)), 32) AS source_id, sha256(content) AS content_hash FROM j)
 SELECT source_uri, source_id, content_hash, source_type, 'job_' || sha256('webex' || chr(0) || source_id || chr(0) || content_hash || chr(0) || hint || chr(0) || 'detected' || chr(0)) AS job_id FROM s""",
)
def channel_jobs(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    attachment = F.array(F.struct(F.concat("role", F.lit(".log")).alias("name"), F.col("role").cast("binary").alias("content")))
    messages = turns.select(
        F.lit("webex").alias("channel"), corpus.text_of("room-", F.col("conv_id")).alias("conversation_id"), corpus.text_of("m", F.col("turn")).alias("message_id"), "text", attachment.alias("attachments")
    )
    return channels.message_jobs(messages).select("source_uri", "source_id", "content_hash", "source_type", "job_id")


@query(
    "channel_normalize",
    """SELECT conv_id, turn, 'room-' || conv_id AS conversation_id, 'm' || turn AS message_id, CASE WHEN role = 'system' THEN 'bot@x' ELSE role END AS actor_id,
  CASE WHEN turn > 0 THEN 'm' || (turn - 1) END AS thread_id, CASE WHEN turn > 0 THEN 'm' || (turn - 1) END AS reply_target, 'internal' AS auth_scope, text, 'm' || turn AS event_id FROM conversations""",
)
def channel_normalize(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    system, even = F.col("role") == "system", F.col("turn") % 2 == 0
    payload = F.to_json(
        F.struct(
            F.when(even, corpus.text_of("room-", F.col("conv_id"))).alias("roomId"), F.when(~even, corpus.text_of("room-", F.col("conv_id"))).alias("conversation_id"),
            corpus.text_of("m", F.col("turn")).alias("id"), F.when(~system, F.col("role")).alias("personId"), F.when(system, F.lit("bot@x")).alias("personEmail"),
            F.when(F.col("turn") > 0, corpus.text_of("m", F.col("turn") - 1)).alias("parentId"), F.when(even, F.col("text")).alias("text"), F.when(~even, F.col("text")).alias("markdown"),
        )
    )
    raw = turns.select("conv_id", "turn", payload.alias("payload"))
    columns = ["conversation_id", "message_id", "actor_id", "thread_id", "reply_target", "auth_scope", "text", "event_id"]
    return channels.normalize_events(raw, "webex").select("conv_id", "turn", *columns)


@query(
    "ingest_chunks",
    f"""WITH RECURSIVE {S.chunker('documents', 'doc_id', 900, False)}, v AS (SELECT doc_id, lang, 'srcver_' || sha256('source-version:doc-' || doc_id || ':' || sha256(text) || ':1') AS version_id, 'docs/' || doc_id || '.txt' AS uri FROM documents),
 n AS (SELECT b.*, v.lang, v.version_id, v.uri, row_number() OVER (PARTITION BY b.doc_id ORDER BY line_start) - 1 AS ordinal FROM blocks b JOIN v ON v.doc_id = b.doc_id)
 SELECT 'doc-' || doc_id AS source_id, lang AS domain_id, ordinal, 'chunk_' || sha256('chunk:' || version_id || ':' || ordinal) AS chunk_id,
  uri || CASE WHEN line_start <> line_end THEN ':L' || line_start || '-L' || line_end ELSE ':L' || line_start END AS locator FROM n""",
)
def ingest_chunks(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    raw = docs.select(corpus.text_of("doc-", F.col("doc_id")).alias("source_id"), corpus.text_of("docs/", F.col("doc_id"), ".txt").alias("source_uri"), F.col("text").alias("content"), F.col("lang").alias("domain_id"))
    return I.chunk_rows(I.prepare_sources(raw)).select("source_id", "domain_id", "ordinal", "chunk_id", "locator")


@query(
    "redact_nested_metadata",
    """SELECT event_id, replace(props, ' ', '') AS props, '{"user":' || user_id || ',"token":"[redacted]","deep":[{"password":"[redacted]"},"' || event_type || '"]}' AS auth,
 't' || event_id || ',p' || user_id AS secrets FROM events""",
)
def redact_nested_metadata(spark, sf_dir):
    """Secrets inside JSON values of a metadata map, and the tree that is left."""
    events = corpus.table(spark, sf_dir, "events")
    auth = corpus.text_of('{"user":', F.col("user_id"), ',"token":"t', F.col("event_id"), '","deep":[{"password":"p', F.col("user_id"), '"},"', F.col("event_type"), '"]}')
    meta = F.create_map(F.lit("props"), F.col("props"), F.lit("auth"), auth)
    clean = events.select("event_id", redact.redact_metadata(meta).alias("m"), redact.sensitive_values(meta).alias("s"))
    return clean.select("event_id", F.col("m")["props"].alias("props"), F.col("m")["auth"].alias("auth"), F.array_join("s", ",").alias("secrets"))
