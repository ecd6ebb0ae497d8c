"""Requests as tables, stored tables that change their schema, and spools that are replayed."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.operators.migration import Step, VersionedTable
from attesta.plans import requests as R
from attesta.session import shared_checkpoint_dir
from attesta.sources import corpus
from attesta.streaming import spool

_FREE = "'system: ' || coalesce(source, '') || ', ' || coalesce(lang, '') || chr(10) || 'symptom: timeouts; errors' || chr(10) || 'request_id=req-' || doc_id || chr(10) || coalesce(text, '')"
_AFTER = "regexp_extract(ltrim(substr(q, instr(lower(q), '{0}:') + {1}), ' ' || chr(9) || chr(10) || chr(13)), '^[^\\r\\n]*')"


def _mention(*names: str) -> str:
    whens = " ".join(f"WHEN instr(lower(q), '{n}:') > 0 THEN {_AFTER.format(n, len(n) + 1)}" for n in names)
    return f"trim(CASE {whens} ELSE '' END)"


def _said(words: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower(q), '{w}') OR contains(lower(q), '{w.replace('-', ' ')}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def _items(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[,\\n;]'), lambda x: trim(x)), lambda x: x <> '')"


_LISTS = ("systems", "components", "symptoms", "outputs", "correlation_ids", "source_types")


@query(
    "audit_requests_parsed",
    rf"""WITH free AS (SELECT doc_id, regexp_replace(CASE doc_id % 5 WHEN 0 THEN {_FREE} ELSE '{{"query": ' || coalesce(text, '') END, '^\s+|\s+$', '', 'g') AS q FROM documents WHERE doc_id % 5 IN (0, 4)),
 parsed AS (
 SELECT doc_id, 'text' AS form, q AS query, {_mention('scope', 'for', 'about')} AS scope, {_items(_mention('system', 'systems'))} AS systems, {_items(_mention('component', 'components'))} AS components,
   {_items(_mention('symptom', 'symptoms', 'failure', 'error'))} AS symptoms, {_said(R.OUTPUTS)} AS outputs,
   regexp_extract_all(q, '(?i)(?:correlation[_-]?id|request[_-]?id|trace[_-]?id|session[_-]?id)\s*[:=]\s*([A-Za-z0-9._:-]+)', 1) AS correlation_ids, {_said(R.SOURCE_TYPES)} AS source_types,
   NULL::TIMESTAMP AS since, {' OR '.join(f"contains(lower(q), '{w}')" for w in R.LIVE_WORDS)} AS live_verification, '' AS unknown FROM free
 UNION ALL SELECT doc_id, 'mapping', coalesce(text, ''), '', list_filter([source, lang], lambda x: x IS NOT NULL AND x <> ''), [], [], [], [], [], TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id % 1000)::INT), false, 'k' FROM documents WHERE doc_id % 5 = 1
 UNION ALL SELECT doc_id, 'mapping', coalesce(text, ''), '', ['a', 'b', 'c'], ['7'], ['late', 'lost; twice'], [], ['req-' || doc_id], ['log', 'code'], NULL, true, '' FROM documents WHERE doc_id % 5 = 2
 UNION ALL SELECT doc_id, 'mapping', coalesce(text, ''), coalesce(text, ''), [], [], [], ['timeline', 'findings'], [], [], NULL, false, 'owner' FROM documents WHERE doc_id % 5 = 3)
 SELECT doc_id, form, sha256(query) AS query_hash, sha256(scope) AS scope_hash, {', '.join(f"array_to_string({c}, '|') AS {c}" for c in _LISTS)}, since, live_verification, unknown FROM parsed""",
)
def audit_requests_parsed(spark, sf_dir):
    """Every document's text is asked in one of five forms."""
    docs = corpus.table(spark, sf_dir, "documents")
    key = F.col("doc_id") % 5
    start = F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.concat(F.lit("req-"), F.col("doc_id"))
    listed = F.to_json(F.struct(F.col("text").alias("query"), F.array("source", "lang").alias("systems"), start.alias("from"), F.col("doc_id").alias("k")))
    aliased = F.to_json(
        F.struct(
            F.col("text").alias("request"), F.lit("a, b;c").alias("systems"), F.lit(7).alias("components"), F.array(F.lit("late"), F.lit("lost; twice")).alias("issues"),
            F.array(number).alias("request_ids"), F.lit("log,code").alias("evidence_types"), F.lit(True).alias("live_verification_required"),
        )
    )
    scoped = F.to_json(F.struct(F.lit("").alias("query"), F.col("text").alias("scope"), F.array().cast("array<string>").alias("components"), F.lit("timeline\nfindings").alias("outputs"), F.lit("x").alias("owner")))
    broken = F.concat(F.lit('{"query": '), F.coalesce("text", F.lit("")))
    free = F.expr(_FREE)
    request = F.when(key == 0, free).when(key == 1, listed).when(key == 2, aliased).when(key == 3, scoped).otherwise(broken)
    p = R.parse_requests(docs.select("doc_id", request.alias("request")))
    field = lambda n: F.col(f"parsed.{n}")
    return p.select(
        "doc_id", field("form"), F.sha2(field("query"), 256).alias("query_hash"), F.sha2(field("scope"), 256).alias("scope_hash"),
        *[F.array_join(field(c), "|").alias(c) for c in _LISTS], field("since").alias("since"), field("live_verification"), F.array_join(F.array_sort(F.map_keys(field("unknown"))), ",").alias("unknown"),
    )


RELEASES = [
    Step(2, "scope columns", {"domain_id": "coalesce(nullif(lang, ''), 'general')", "system_id": "coalesce(nullif(source, ''), 'unknown')"}, ("lang", "source")),
    Step(3, "content keys", {"content_hash": "sha2(coalesce(text, ''), 256)", "size_bytes": "cast(octet_length(coalesce(text, '')) as bigint)"}, ("text",)),
]


@query(
    "store_schema_migration",
    """SELECT doc_id, coalesce(nullif(lang, ''), 'general') AS domain_id, coalesce(nullif(source, ''), 'unknown') AS system_id, sha256(coalesce(text, '')) AS content_hash,
 strlen(coalesce(text, ''))::BIGINT AS size_bytes FROM documents""",
)
def store_schema_migration(spark, sf_dir):
    """All documents, stored under version 1 and moved to version 2 and, by a later release, to version 3."""
    root = f"{shared_checkpoint_dir(spark)}/attesta-migration-{uuid.uuid4().hex}"
    VersionedTable(spark, root).create(corpus.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    VersionedTable(spark, root, RELEASES[:1]).migrate()
    moved = VersionedTable(spark, root, RELEASES)
    moved.migrate()
    return moved.read()


@query("spool_replay", "SELECT event_id, user_id, event_type, value FROM events")
def spool_replay(spark, sf_dir):
    """All events from a spool that holds errors twice, by a replay that is stopped between its first write and its commit."""
    events = corpus.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    root = f"{shared_checkpoint_dir(spark)}/attesta-spool-{uuid.uuid4().hex}"
    files, target, checkpoint = (f"{root}/{part}" for part in ("files", "delivered", "checkpoint"))
    events.write.parquet(files)
    events.where("event_type = 'error'").write.mode("append").parquet(files)
    broken: list[int] = []

    def breaks_once(rows, folder, number):
        spool.write_batch(rows, folder, number)
        if not broken:
            broken.append(number)
            raise RuntimeError("stopped between write and commit")

    try:
        spool.replay_spool(spark, files, target, checkpoint, events.schema, sink=breaks_once)
    except StreamingQueryException:
        if not broken:
            raise
    spool.replay_spool(spark, files, target, checkpoint, events.schema)
    return spool.delivered(spark, target, events.schema, ["event_id"], ["event_type", "user_id", "value"])
