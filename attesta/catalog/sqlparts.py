"""Shared fragments of the SQL formulations."""

from __future__ import annotations

from attesta.sources.corpus import DOMAINS, SOURCE_TYPES

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def choice(key: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {whens} END)"


def scope(key: str) -> str:
    return (
        f"{choice(key, ['internal', 'internal', 'team-a', 'public'])} AS acl_scope, 'comp-' || (({key}) % 7) AS component_id, "
        f"{choice(key, ['prod', 'test', 'dev'])} AS environment, {EPOCH} + to_minutes(({key})::INT) AS ingest_ts"
    )


DOCS = f"""docs AS (SELECT doc_id, 'doc-' || doc_id AS chunk_id, 'doc-' || doc_id AS source_id, 'docv-' || doc_id AS source_version_id,
 0::BIGINT AS ordinal, text, 'docs/' || source || '/' || doc_id || '.md' AS source_uri, lang AS domain_id, source AS system_id,
 {choice('doc_id', SOURCE_TYPES)} AS source_type, {choice('doc_id', SOURCE_TYPES)} AS evidence_type, {scope('doc_id')} FROM documents)"""


def _evidence(prefix: str, key: str, text: str, uri: str, source_type: str, table: str) -> str:
    return (
        f"SELECT '{prefix}-' || {key} AS chunk_id, '{prefix}-' || {key} AS source_id, '{prefix}v-' || {key} AS source_version_id, 0::BIGINT AS ordinal, "
        f"{text} AS text, {uri} AS source_uri, {uri} || ':L1' AS locator, sha256({text}) AS chunk_hash, {choice(key, DOMAINS)} AS domain_id, "
        f"'sys-' || ({key} % 6) AS system_id, '{source_type}' AS source_type, '{source_type}' AS evidence_type, {scope(key)} FROM {table}"
    )


_NL = "chr(10)"
_K = "json_extract_string(props, '$.k')"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
LOG_TEXT = (
    f"{_ISO} || ' host-' || (user_id % 5) || ' request_id=req-' || event_id || ' correlation_id=corr-' || user_id || ' ' || "
    f"(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END) || ' ' || event_type || ' handled' || "
    f"(CASE WHEN event_type = 'error' THEN {_NL} || '  File \"src/part_' || {_K} || '.py\", line ' || {_K} ELSE '' END)"
)
CSV_TEXT = f"'_time,host,message' || {_NL} || {_ISO} || ',host-' || (user_id % 5) || ',' || event_type || ' correlation_id=corr-' || user_id"
CODE_TEXT = (
    f"'import catalog' || {_NL} || 'class Part' || p_partkey || ':' || {_NL} || '    def size_' || p_size || '(self):' || {_NL} || '        return load_' || p_size || "
    f"'(\"' || p_brand || '\")' || {_NL} || 'def load_' || p_size || '(brand):' || {_NL} || '    try:' || {_NL} || '        return catalog.find(brand)' || {_NL} || "
    f"'    except KeyError:' || {_NL} || '        logger.error(brand)'"
)
DDL_TEXT = f"'CREATE TABLE supplier_' || s_suppkey || ' (' || {_NL} || '  id INT,' || {_NL} || '  nation_' || s_nationkey || ' VARCHAR(25)' || {_NL} || ');' || {_NL} || '-- query path'"
OUT_TEXT = (
    f"'order_key | status | priority' || {_NL} || '-----' || {_NL} || "
    f"(CASE WHEN o_orderstatus = 'P' THEN '-- 0 rows' ELSE o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority END)"
)
LOGS = _evidence("log", "event_id", LOG_TEXT, "'logs/app-' || (user_id % 5) || '.log'", "log", "events")
EXPORTS = _evidence("csv", "event_id", CSV_TEXT, "'exports/' || event_id || '.csv'", "splunk-csv", "events")
CODE = _evidence("code", "p_partkey", CODE_TEXT, "'repo/src/part_' || p_partkey || '.py'", "code", "part")
SCHEMAS = _evidence("ddl", "s_suppkey", DDL_TEXT, "'db/supplier_' || s_suppkey || '.sql'", "schema", "supplier")
OUTPUTS = _evidence("out", "o_orderkey", OUT_TEXT, "'out/order_' || o_orderkey || '.txt'", "query-output", "orders")
INTEGRATIONS = _evidence("page", "page_id", f"url || {_NL} || html", "url", "integration", "pages")
PROSE = _evidence("doc", "doc_id", f"'Controlled verification of ' || source || {_NL} || text", "'docs/' || source || '/' || doc_id || '.md'", "document", "documents")
EVIDENCE = "evidence AS (" + " UNION ALL ".join([LOGS, EXPORTS, CODE, INTEGRATIONS, SCHEMAS, OUTPUTS, PROSE]) + ")"
TURNS = "turns AS (SELECT 'turn-' || conv_id || '-' || turn AS chunk_id, 'conv-' || conv_id AS source_version_id, turn::BIGINT AS ordinal, text, role, conv_id FROM conversations)"


def terms(x: str) -> str:
    tokens = f"list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+(?:[./:-][\\p{{L}}\\p{{N}}_]+)*'), lambda t: replace(lower(t), 'ß', 'ss'))"
    return f"list_filter(list_distinct(list_concat({tokens}, flatten(list_transform({tokens}, lambda t: string_split_regex(t, '[._/:+-]+'))))), lambda t: t <> '')"


def lexical(text: str, query_terms: list[str]) -> str:
    literal = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in query_terms) + "]"
    return f"len(list_intersect({terms(text)}, {literal}))::DOUBLE / {len(query_terms)}"


def chunker(source: str, keep: str, limit: int, overshoot: bool) -> str:
    """Recursive CTEs ``lines``, ``walk`` and ``blocks`` that pack the lines of ``source.text``."""
    grow = "length(l.line)" if overshoot else "length(l.line) + 1"
    fits = f"w.chars < {limit}" if overshoot else f"w.chars < {limit} AND w.chars + length(l.line) + 1 <= {limit}"
    return f"""lines AS (SELECT {keep}, i::BIGINT AS n, parts[i] AS line, len(parts) AS total FROM (
   SELECT {keep}, string_split(text, chr(10)) AS parts FROM {source}) s, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) g),
 walk AS (SELECT {keep}, n, line, 1::BIGINT AS start, length(line)::BIGINT AS chars, FALSE AS skipped FROM lines WHERE n = 1
   UNION ALL
   SELECT {', '.join('l.' + k.strip() for k in keep.split(','))}, l.n, l.line,
     CASE WHEN NOT w.skipped AND trim(l.line) = '' THEN w.start WHEN NOT w.skipped AND {fits} THEN w.start ELSE l.n END,
     CASE WHEN NOT w.skipped AND trim(l.line) = '' THEN w.chars WHEN NOT w.skipped AND {fits} THEN w.chars + {grow} ELSE length(l.line) END,
     NOT w.skipped AND trim(l.line) = ''
   FROM walk w JOIN lines l ON l.n = w.n + 1 AND {' AND '.join('l.' + k.strip() + ' = w.' + k.strip() for k in keep.split(','))}),
 blocks AS (SELECT {keep}, start AS line_start, max(n) AS line_end, trim(string_agg(line, chr(10) ORDER BY n)) AS text
   FROM walk WHERE NOT skipped GROUP BY {keep}, start)"""


#: A query vector for searches over the embeddings of documents (64 dimensions).
QUERY_VECTOR = [((i * 7919) % 13 - 6) / 10 for i in range(64)]
#: Vectors of documents by chunk id, and the similarity to the query vector (0 without a vector).
SIMILARITY = f"sim AS (SELECT 'doc-' || vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}::DOUBLE[]) AS semantic_score FROM embeddings)"
HYBRID = "0.75 * coalesce(semantic_score, 0) + 0.25 * lexical_score"
