"""Identifiers, tokenising and text measures over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import extract, ids
from attesta.functions import text as T
from attesta.sources import corpus

PARSER = "'v1'"


@query(
    "ids_chunk_version",
    f"""WITH {S.DOCS}, h AS (SELECT *, sha256(text) AS content_hash FROM docs),
 v AS (SELECT *, 'srcver_' || sha256('source-version:' || source_id || ':' || content_hash || ':v1') AS version_id FROM h)
 SELECT doc_id, content_hash, version_id, sha256(content_hash || ':v1') AS artifact_hash,
   'chunk_' || sha256('chunk:' || version_id || ':0') AS chunk_digest, sha256(version_id || ':0:' || text) AS chunk_hash FROM v""",
)
def ids_chunk_version(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir).withColumn("content_hash", ids.content_hash("text"))
    versioned = docs.withColumn("version_id", ids.source_version_id(F.col("source_id"), F.col("content_hash"), F.lit("v1")))
    version, zero = F.col("version_id"), F.lit(0)
    return versioned.select(
        "doc_id", "content_hash", "version_id", ids.artifact_hash(F.col("content_hash"), F.lit("v1")).alias("artifact_hash"),
        ids.chunk_id(version, zero).alias("chunk_digest"), ids.chunk_hash(version, zero, F.col("text")).alias("chunk_hash"),
    )


_Z = "chr(0)"


def _sql_terminated(*parts: str) -> str:
    return "sha256(" + " || ".join(f"{p} || {_Z}" for p in parts) + ")"


@query(
    "stable_id_families",
    f"""WITH {S.DOCS} SELECT doc_id,
  'ns_' || left({_sql_terminated('domain_id', 'system_id', 'component_id', 'environment', 'evidence_type', 'acl_scope')}, 32) AS namespace_id,
  'edge_' || left({_sql_terminated('source_id', 'system_id', "'feeds'")}, 32) AS edge_id,
  'sym_' || left(sha256(source_version_id || {_Z} || source_id || {_Z} || '7'), 32) AS symbol_id,
  'src_' || left({_sql_terminated("'directory'", 'source_uri', "''")}, 32) AS ingest_source_id,
  'job_' || {_sql_terminated("'directory'", 'source_id', 'sha256(text)', 'source_type', "'detected'")} AS job_id,
  'finding_' || left({_sql_terminated("'fact'", 'source_id')}, 24) AS finding_id,
  'pkg_' || left({_sql_terminated("'pkg'", "'q'", "'docs'", 'source_version_id')}, 24) AS package_id
 FROM docs""",
)
def stable_id_families(spark, sf_dir):
    c = F.col
    return corpus.documents(spark, sf_dir).select(
        "doc_id",
        ids.namespace_id(c("domain_id"), c("system_id"), c("component_id"), c("environment"), c("evidence_type"), c("acl_scope")).alias("namespace_id"),
        ids.edge_id(c("source_id"), c("system_id"), F.lit("feeds")).alias("edge_id"),
        ids.index_id("sym", c("source_version_id"), c("source_id"), F.lit("7")).alias("symbol_id"),
        ids.ingest_source_id(F.lit("directory"), c("source_uri")).alias("ingest_source_id"),
        ids.job_id(F.lit("directory"), c("source_id"), ids.content_hash("text"), c("source_type")).alias("job_id"),
        ids.audit_id("finding", F.lit("fact"), c("source_id")).alias("finding_id"),
        ids.scoped_id("pkg", F.lit("q"), F.lit("docs"), c("source_version_id")).alias("package_id"),
    )


@query(
    "lexical_terms",
    f"SELECT doc_id, len({S.terms('text')})::BIGINT AS n_terms, sha256(array_to_string(list_sort({S.terms('text')}), ' ')) AS terms_hash FROM documents",
)
def lexical_terms(spark, sf_dir):
    terms = corpus.table(spark, sf_dir, "documents").select("doc_id", T.lexical_terms(F.col("text")).alias("terms"))
    return terms.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.sha2(F.array_join(F.sort_array("terms"), " "), 256).alias("terms_hash"))


@query(
    "text_measures",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_./:-]+'))::BIGINT AS word_tokens,
  greatest(1, (length(text) + 3) // 4)::BIGINT AS est_tokens, strlen(text)::BIGINT AS est_bytes,
  len(regexp_extract_all(text, '[A-Za-z0-9_./:-]+'))::BIGINT AS embedding_tokens,
  sha256(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./:-]+'), lambda t: lower(t)), ' ')) AS embedding_token_hash,
  trim(string_split(text, chr(10))[1]) AS statement FROM documents""",
)
def text_measures(spark, sf_dir):
    text = F.col("text")
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id",
        T.word_token_count(text).cast("long").alias("word_tokens"),
        T.estimated_tokens(text).alias("est_tokens"),
        T.estimated_bytes(text).alias("est_bytes"),
        F.size(T.embedding_tokens(text)).cast("long").alias("embedding_tokens"),
        F.sha2(F.array_join(T.embedding_tokens(text), " "), 256).alias("embedding_token_hash"),
        T.first_line(text).alias("statement"),
    )


@query(
    "term_score",
    "SELECT conv_id, turn, (contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'zz-none')::INT)::DOUBLE / 3 AS score FROM conversations",
)
def term_score(spark, sf_dir):
    return corpus.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.term_score(F.lower("text"), T.split_terms("The, tion; zz-none")).alias("score")
    )


@query(
    "chunk_locators",
    """SELECT doc_id, source || CASE WHEN nl > 1 THEN ':L1-L' || nl ELSE ':L1' END AS by_lines, source || '#chunk-' || (doc_id % 9 + 1) AS by_ordinal
 FROM (SELECT doc_id, source, len(string_split(text, chr(10))) AS nl FROM documents)""",
)
def chunk_locators(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    lines, none = F.size(T.splitlines(F.col("text"))), F.lit(None).cast("int")
    return docs.select(
        "doc_id",
        T.chunk_locator(F.col("source"), F.lit(0), F.lit(1), lines).alias("by_lines"),
        T.chunk_locator(F.col("source"), F.col("doc_id") % 9, none, none).alias("by_ordinal"),
    )


@query(
    "uri_properties",
    r"""SELECT page_id, url, 'webex://rooms/' || page_id || '/messages/' || (page_id % 10) AS room_uri,
  CASE lower(regexp_extract(url, '(\.[^.]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.sql' THEN 'sql' WHEN '.ps1' THEN 'powershell' WHEN '.psm1' THEN 'powershell' END AS language,
  regexp_replace(url, '^.*/([^/]+?)/*$', '\1') AS file_name FROM pages""",
)
def uri_properties(spark, sf_dir):
    from attesta.sources.channels import source_uri

    pages = corpus.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", "url", source_uri(F.lit("webex"), F.col("page_id"), F.col("page_id") % 10).alias("room_uri"),
        extract.language(F.col("url")).alias("language"), extract.file_name(F.col("url")).alias("file_name"),
    )
