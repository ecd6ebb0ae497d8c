"""Scope predicates and guards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import extract, guards, redact
from attesta.operators import filters as O
from attesta.operators.filters import RetrievalFilters
from attesta.sources import corpus


@query(
    "filter_acl_domain_time",
    f"""WITH {S.DOCS} SELECT doc_id, acl_scope, domain_id, ingest_ts FROM docs WHERE acl_scope IN ('internal', 'team-a') AND domain_id IN ('en', 'fr')
 AND ingest_ts >= TIMESTAMP '2024-01-01 00:30:00' AND ingest_ts <= TIMESTAMP '2024-01-01 12:00:00'""",
)
def filter_acl_domain_time(spark, sf_dir):
    f = RetrievalFilters(
        principal_acl_scopes=("internal", "team-a", ""), domain_ids=("en", "fr", "en"), since=datetime(2024, 1, 1, 0, 30), until=datetime(2024, 1, 1, 12)
    )
    docs = corpus.documents(spark, sf_dir)
    return docs.where(O.compile_filters(f, columns=docs.columns)).select("doc_id", "acl_scope", "domain_id", "ingest_ts")


@query(
    "filter_delegated_domains",
    f"WITH {S.DOCS} SELECT doc_id, domain_id FROM docs WHERE domain_id IN ('de', 'es')",
)
def filter_delegated_domains(spark, sf_dir):
    f = RetrievalFilters(principal_domain_id=" de ", delegated_domain_ids=("es", "de"), domain_ids=("en",))
    return corpus.documents(spark, sf_dir).where(O.compile_filters(f)).select("doc_id", "domain_id")


@query(
    "filter_scope_lists",
    f"""WITH {S.DOCS} SELECT doc_id, system_id, component_id, environment, evidence_type FROM docs WHERE system_id IN ('src1', 'src3', 'src5')
 AND component_id IN ('comp-1', 'comp-4', 'comp-6') AND environment IN ('prod', 'dev') AND evidence_type IN ('document', 'log', 'code')""",
)
def filter_scope_lists(spark, sf_dir):
    f = RetrievalFilters(
        systems=("src1", "src3", "src5"), component_ids=("comp-1", "comp-4", "comp-6"), environments=("prod", "dev"), evidence_types=("document", "log", "code")
    )
    return corpus.documents(spark, sf_dir).where(O.compile_filters(f)).select("doc_id", "system_id", "component_id", "environment", "evidence_type")


@query(
    "channel_allow_list",
    "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 400 AND turn IN (0, 1, 2)",
)
def channel_allow_list(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations").withColumns(
        {"actor_id": F.col("role"), "conversation_id": F.when(F.char_length("text") > 400, F.lit("long-form")).otherwise(F.lit("short")), "reply_target": F.lit(None).cast("string"),
         "message_id": F.col("turn").cast("string"), "auth_scope": F.lit("internal")}
    )
    return turns.where(O.allow_list(["user", "assistant"], ["long-form"], ["0", "1", "2"])).select("conv_id", "turn", "role")


@query(
    "acl_scope_subset",
    f"""WITH {S.DOCS} SELECT domain_id, system_id, bool_and(acl_scope IN ('internal', 'public')) AS within FROM docs GROUP BY domain_id, system_id""",
)
def acl_scope_subset(spark, sf_dir):
    scopes = corpus.documents(spark, sf_dir).groupBy("domain_id", "system_id").agg(F.collect_set("acl_scope").alias("scopes"))
    return scopes.select("domain_id", "system_id", O.scopes_within(F.col("scopes"), ["internal", "public"]).alias("within"))


_STATEMENT = (
    "CASE event_id % 7 WHEN 0 THEN 'SELECT * FROM t_' || user_id WHEN 1 THEN 'delete from t_' || user_id WHEN 2 THEN 'SELECT 1; SELECT ' || user_id "
    "WHEN 3 THEN 'DESCRIBE t_' || user_id WHEN 4 THEN '  ' WHEN 5 THEN 'show tables like ' || user_id ELSE ' with x as (select ' || user_id || ') select * from x;' END"
)


@query(
    "sql_guard",
    f"""SELECT event_id, CASE WHEN trim(s) = '' THEN 'empty' WHEN regexp_matches(trim(s), ';\\s*\\S') THEN 'multiple statements'
  WHEN regexp_matches(trim(s), '(?i)\\b(insert|update|delete|merge|create|alter|drop|truncate|grant|revoke|commit|rollback|execute|exec|call|declare|begin|end|shutdown|replace|attach|detach|vacuum|analyze)\\b') THEN 'write-capable'
  WHEN NOT regexp_matches(upper(trim(s)), '^(SELECT|WITH|DESC)') THEN 'not read-only' END AS rejection FROM (SELECT event_id, {_STATEMENT} AS s FROM events)""",
)
def sql_guard(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events")
    return events.select("event_id", guards.sql_rejection(F.expr(_STATEMENT)).alias("rejection"))


@query(
    "reference_guards",
    r"""SELECT page_id, regexp_matches(url, '^[A-Za-z0-9._@:/+-]{1,128}$') AS safe_label, regexp_matches(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://|ref:)[^\s]{1,256}$') AS safe_reference,
  NOT regexp_matches(regexp_replace(url, '^https?:/', ''), '^/|(^|/)\.\.(/|$)') AS safe_path, page_id % 2 = 0 AS has_secret_keys FROM pages""",
)
def reference_guards(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    meta = F.create_map(F.when(F.col("page_id") % 2 == 0, F.lit("password")).otherwise(F.lit("owner")), F.col("url"))
    return pages.select(
        "page_id", guards.is_safe_label(F.col("url")).alias("safe_label"), guards.is_safe_reference(F.col("url")).alias("safe_reference"),
        guards.is_safe_path(F.regexp_replace("url", "^https?:/", "")).alias("safe_path"), guards.has_secret_keys(meta).alias("has_secret_keys"),
    )


@query(
    "private_endpoint",
    r"""SELECT page_id, endpoint, regexp_matches(host, '^(localhost|127\.|0\.0\.0\.0|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)')
   OR regexp_matches(host, '\.(internal|local|corp|lan)$') OR contains(authority, '@') AS private
 FROM (SELECT *, regexp_replace(regexp_replace(authority, '^.*@', ''), ':.*$', '') AS host FROM (
   SELECT *, regexp_extract(lower(endpoint), '^https?://([^/?#]*)', 1) AS authority FROM (
     SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '\.example\.(com|net|org)', '.internal') WHEN 1 THEN regexp_replace(url, '://', '://user:pw@')
       WHEN 2 THEN regexp_replace(url, '//[^/]*', '//10.1.' || (page_id % 200) || '.7:8080') ELSE url END AS endpoint FROM pages)))""",
)
def private_endpoint(spark, sf_dir):
    pages, key = corpus.table(spark, sf_dir, "pages"), F.col("page_id")
    endpoint = (
        F.when(key % 5 == 0, F.regexp_replace("url", r"\.example\.(com|net|org)", ".internal"))
        .when(key % 5 == 1, F.regexp_replace("url", "://", "://user:pw@"))
        .when(key % 5 == 2, F.regexp_replace(F.col("url"), F.lit("//[^/]*"), corpus.text_of("//10.1.", key % 200, ".7:8080")))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", endpoint.alias("endpoint")).withColumn("private", redact.is_private_endpoint(F.col("endpoint")))


_SUFFIXES = [".py", ".csv", ".json", ".docx", ".sql", ".log", ".xlsx", ".tar.gz", ".md", ".bin", ".yaml", ".PS1"]


@query(
    "classify_suffix",
    f"""SELECT page_id, name, suffix, CASE WHEN suffix = '.docx' THEN 'document' WHEN suffix = '.csv' THEN 'csv' WHEN suffix IN ('.json', '.yaml') THEN substr(suffix, 2) WHEN suffix IN ('.xlsx', '.sql') THEN 'schema'
   WHEN suffix = '.py' THEN 'python' WHEN suffix = '.ps1' THEN 'powershell' WHEN suffix = '.log' THEN 'log' ELSE 'document' END AS source_type,
  CASE WHEN suffix = '.csv' THEN 'table' WHEN suffix IN ('.xlsx', '.sql') THEN 'schema' WHEN suffix IN ('.py', '.ps1') THEN 'code' WHEN suffix = '.log' THEN 'log' ELSE 'document' END AS source_kind,
  suffix = '.tar.gz' AS is_archive, NOT (suffix IN ('.csv', '.json', '.yaml') AND page_id % 5 = 0) AS mime_ok
 FROM (SELECT page_id, name, CASE WHEN ends_with(name, '.tar.gz') THEN '.tar.gz' ELSE lower(regexp_extract(name, '(\\.[^.]+)$', 1)) END AS suffix
   FROM (SELECT page_id, 'page-' || page_id || {S.choice('page_id', _SUFFIXES)} AS name FROM pages))""",
)
def classify_suffix(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    named = pages.select("page_id", corpus.text_of("page-", F.col("page_id"), corpus._choice(F.col("page_id"), _SUFFIXES)).alias("name"))
    kind, suffix = guards.classify(F.col("name")), guards.file_suffix(F.col("name"))
    declared = F.when(F.col("page_id") % 5 == 0, F.lit("image/png"))
    return named.select(
        "page_id", "name", suffix.alias("suffix"), kind["source_type"].alias("source_type"), kind["source_kind"].alias("source_kind"),
        guards.is_archive(F.col("name")).alias("is_archive"), guards.mime_matches_suffix(guards.canonical_mime(F.col("name"), declared), suffix).alias("mime_ok"),
    )


@query(
    "secret_scan",
    r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:BEGIN [A-Z ]+PRIVATE KEY|(?:api[_-]?key|password|secret|token)\s*[:=])')",
)
def secret_scan(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").where(extract.has_secret(F.col("text"))).select("doc_id")
