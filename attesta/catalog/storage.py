"""Idempotent writes, versions, status, provenance and namespaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import ids
from attesta.operators import filters as O
from attesta.operators import namespaces, store
from attesta.operators.filters import RetrievalFilters
from attesta.plans import retrieval as P
from attesta.sources import corpus


@query("content_put", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id) GROUP BY sha256(text)")
def content_put(spark, sf_dir):
    """Store every document's bytes; the labelled documents are already stored."""
    objects = corpus.table(spark, sf_dir, "documents").select(ids.content_hash("text").alias("content_hash"), "doc_id")
    labelled = corpus.table(spark, sf_dir, "labels").select("doc_id")
    return store.put_objects(objects.join(labelled, "doc_id", "left_semi"), objects, order="doc_id").select("content_hash", "doc_id")


@query("content_get", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE sha256(text) IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)")
def content_get(spark, sf_dir):
    objects = corpus.table(spark, sf_dir, "documents").select("doc_id", ids.content_hash("text").alias("content_hash"))
    flagged = corpus.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    keys = objects.join(flagged, "doc_id", "left_semi").select("content_hash").distinct()
    return objects.join(keys, "content_hash", "left_semi").select("doc_id", "content_hash")


@query("idempotent_save", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o JOIN labels l ON l.doc_id = o.doc_id WHERE o.source = d.source AND sha256(o.text) = sha256(d.text))")
def idempotent_save(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), ids.content_hash("text").alias("content_hash"))
    stored = docs.join(corpus.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return store.new_rows(stored, docs, ["source_id", "content_hash"]).select("doc_id")


@query("version_numbers", "SELECT source AS source_id, content_hash, row_number() OVER (PARTITION BY source ORDER BY first_seen) AS version_number FROM (SELECT source, sha256(text) AS content_hash, min(doc_id) AS first_seen FROM documents GROUP BY 1, 2)")
def version_numbers(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    observed = docs.select(F.col("source").alias("source_id"), ids.content_hash("text").alias("content_hash"), F.col("doc_id").alias("seq"))
    return store.version_numbers(observed).select("source_id", "content_hash", "version_number")


@query(
    "latest_wins_upsert",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS seq, min(ts) AS created_at FROM events GROUP BY user_id",
)
def latest_wins_upsert(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"), F.col("ts").alias("created_at"))
    stored = F.col("seq") % 3 == 0
    return store.upsert(events.where(stored), events.where(~stored), ["user_id"], "seq", keep_earliest=["created_at"])


@query("legacy_defaults", "SELECT doc_id, 'ns_doc-' || doc_id AS namespace_id, coalesce(lang, 'general') AS domain_id, CASE WHEN source = 'src3' THEN 'unknown' ELSE source END AS system_id, 'unknown-component' AS component_id, 'document' AS evidence_type FROM documents")
def legacy_defaults(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    old = docs.select("doc_id", corpus.text_of("doc-", F.col("doc_id")).alias("source_id"), F.col("lang").alias("domain"), F.when(F.col("source") != "src3", F.col("source")).otherwise("").alias("system"))
    return store.with_legacy_defaults(old).select("doc_id", "namespace_id", "domain_id", "system_id", "component_id", "evidence_type")


def _star(spark, sf_dir):
    """Sources per crawl source, versions per document, chunks per line, vectors by document."""
    docs = corpus.documents(spark, sf_dir)
    sources = docs.groupBy(F.col("system_id").alias("source_id")).agg(F.min("domain_id").alias("first_domain"), F.count(F.lit(1)).alias("docs"))
    versions = docs.select("source_version_id", F.col("system_id").alias("source_id"), F.col("doc_id").alias("version_number"), "ingest_ts", F.sha2("text", 256).alias("artifact_hash"))
    lines = docs.select("source_version_id", F.col("system_id").alias("source_id"), "doc_id", "acl_scope", "domain_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    chunks = lines.withColumn("chunk_id", F.when(F.col("ordinal") == 0, corpus.text_of("doc-", F.col("doc_id"))).otherwise(corpus.text_of("doc-", F.col("doc_id"), "#", F.col("ordinal"))))
    vectors = corpus.table(spark, sf_dir, "embeddings").select(corpus.text_of("doc-", F.col("vec_id")).alias("chunk_id"), corpus.text_of("space-", F.col("label") % 3).alias("embedding_space_id"), "vec_id")
    return sources, versions, chunks, vectors


_STAR = f"""{S.DOCS}, sources AS (SELECT system_id AS source_id, min(domain_id) AS first_domain, count(*) AS docs FROM docs GROUP BY 1),
 versions AS (SELECT source_version_id, system_id AS source_id, doc_id AS version_number, ingest_ts, sha256(text) AS artifact_hash FROM docs),
 chunks AS (SELECT source_version_id, system_id AS source_id, doc_id, acl_scope, domain_id, i - 1 AS ordinal, 'doc-' || doc_id || CASE WHEN i > 1 THEN '#' || (i - 1) ELSE '' END AS chunk_id
   FROM docs, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)),
 vectors AS (SELECT 'doc-' || vec_id AS chunk_id, 'space-' || (label % 3) AS embedding_space_id, vec_id FROM embeddings)"""


@query(
    "candidate_star_join",
    f"""WITH {_STAR}, artifacts AS (SELECT artifact_hash, count(*) AS copies FROM versions GROUP BY 1)
 SELECT c.chunk_id, c.ordinal, c.source_id, s.docs, v.version_number, a.copies, e.vec_id FROM chunks c JOIN versions v ON v.source_version_id = c.source_version_id JOIN sources s ON s.source_id = c.source_id
 JOIN artifacts a ON a.artifact_hash = v.artifact_hash LEFT JOIN vectors e ON e.chunk_id = c.chunk_id AND e.embedding_space_id = 'space-1' WHERE c.acl_scope IN ('internal') AND c.domain_id IN ('en', 'de')""",
)
def candidate_star_join(spark, sf_dir):
    sources, versions, chunks, vectors = _star(spark, sf_dir)
    artifacts = versions.groupBy("artifact_hash").agg(F.count(F.lit(1)).alias("copies"))
    f = RetrievalFilters(principal_acl_scopes=("internal",), domain_ids=("en", "de"), embedding_space_id="space-1")
    star = P.candidates(chunks.drop("line"), sources.select("source_id", "docs"), versions.drop("source_id", "ingest_ts"), artifacts, vectors, f)
    return star.select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "source_id", "docs", "version_number", "copies", "vec_id")


@query(
    "source_status",
    f"""WITH {_STAR}, n AS (SELECT source_id, count(*) AS chunks FROM chunks GROUP BY 1), m AS (SELECT source_id, count(DISTINCT source_version_id) AS versions FROM versions GROUP BY 1),
 e AS (SELECT c.source_id, array_to_string(list_sort(list_distinct(list(v.embedding_space_id))), ',') AS spaces FROM chunks c JOIN vectors v ON v.chunk_id = c.chunk_id GROUP BY 1)
 SELECT s.source_id, coalesce(m.versions, 0) AS versions, coalesce(n.chunks, 0) AS chunks, coalesce(e.spaces, '') AS spaces FROM sources s LEFT JOIN n ON n.source_id = s.source_id LEFT JOIN m ON m.source_id = s.source_id LEFT JOIN e ON e.source_id = s.source_id""",
)
def source_status(spark, sf_dir):
    sources, versions, chunks, vectors = _star(spark, sf_dir)
    result = store.statuses(sources.select("source_id"), versions, chunks, vectors)
    return result.select("source_id", "versions", "chunks", F.array_join("embedding_space_ids", ",").alias("spaces"))


@query(
    "provenance_latest",
    f"""WITH {_STAR}, latest AS (SELECT source_id, arg_max(source_version_id, version_number) AS source_version_id, max(version_number) AS version_number, arg_max(artifact_hash, version_number) AS artifact_hash FROM versions GROUP BY 1)
 SELECT l.source_id, l.source_version_id, l.version_number, l.artifact_hash, c.ordinal, c.chunk_id FROM latest l JOIN chunks c ON c.source_version_id = l.source_version_id""",
)
def provenance_latest(spark, sf_dir):
    _, versions, chunks, _ = _star(spark, sf_dir)
    artifacts = versions.select("artifact_hash").distinct()
    rows = store.provenance(versions.drop("ingest_ts"), artifacts, chunks.select("source_version_id", "ordinal", "chunk_id"))
    return rows.select("source_id", "source_version_id", "version_number", "artifact_hash", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id")


@query(
    "artifact_provenance",
    f"WITH {_STAR} SELECT artifact_hash, count(*) AS versions, count(DISTINCT source_id) AS sources, min(version_number) AS first_version FROM versions GROUP BY 1 HAVING count(*) > 1",
)
def artifact_provenance(spark, sf_dir):
    """Artifacts that several versions share."""
    _, versions, _, _ = _star(spark, sf_dir)
    shared = versions.groupBy("artifact_hash").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("source_id").alias("sources"), F.min("version_number").alias("first_version"))
    return shared.where("versions > 1")


@query(
    "list_sources_active",
    f"WITH {S.DOCS} SELECT d.doc_id, d.acl_scope, 'active' AS status FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.acl_scope IN ('internal', 'team-a') AND coalesce(l.toxic, 0) = 0",
)
def list_sources_active(spark, sf_dir):
    """Sources whose document is labelled toxic have been retired."""
    labels = corpus.table(spark, sf_dir, "labels")
    docs = corpus.documents(spark, sf_dir).join(labels, "doc_id", "left")
    retired = F.map_from_arrays(F.array(F.lit("status")), F.array(F.lit("retired")))
    sources = docs.withColumn("metadata", F.when(F.col("toxic") == 1, retired).otherwise(F.create_map().cast("map<string,string>")))
    visible = sources.where(O.admin_visible(RetrievalFilters(principal_acl_scopes=("internal", "team-a"))))
    return visible.select("doc_id", "acl_scope", O.source_status().alias("status"))


@query("embedding_migration_pending", f"WITH {_STAR} SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors WHERE embedding_space_id = 'space-2')")
def embedding_migration_pending(spark, sf_dir):
    _, _, chunks, vectors = _star(spark, sf_dir)
    return store.pending_embeddings(chunks.select("chunk_id"), vectors, "space-2")


@query("embedding_save_guard", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def embedding_save_guard(spark, sf_dir):
    chunks = corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return store.chunk_guard(corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "vec_id"), chunks).select("vec_id")


_NS = (
    f"'ns_' || left(sha256(domain_id || chr(0) || system_id || chr(0) || component_id || chr(0) || environment || chr(0) || evidence_type || chr(0) || acl_scope || chr(0)), 32)"
)
_NS_ROWS = f"""{S.EVIDENCE}, described AS (SELECT {_NS} AS namespace_id, domain_id, system_id, component_id, environment, evidence_type, acl_scope FROM (
  SELECT domain_id, domain_id || '_casework' AS system_id, component_id, environment, evidence_type, acl_scope FROM evidence))"""


def _described(spark, sf_dir):
    rows = corpus.evidence(spark, sf_dir).select("domain_id", "component_id", "environment", "evidence_type", "acl_scope")
    return rows


@query(
    "namespace_registry",
    f"""WITH {_NS_ROWS} SELECT DISTINCT namespace_id, domain_id, system_id, component_id, environment, evidence_type, acl_scope, domain_id AS asset_name,
  domain_id || '/' || system_id || '/' || component_id || ' [' || evidence_type || '] in ' || environment AS sanitized_summary FROM described""",
)
def namespace_registry(spark, sf_dir):
    return namespaces.registry(_described(spark, sf_dir)).drop("component_name")


@query(
    "integration_edges",
    f"""WITH {_NS_ROWS}, d AS (SELECT DISTINCT * FROM described), t AS (SELECT d.*, 'encargos_sigef' AS td, {_NS.replace('domain_id', "'encargos_sigef'")} AS target_namespace_id FROM d WHERE evidence_type = 'code')
 SELECT 'edge_' || left(sha256(namespace_id || chr(0) || target_namespace_id || chr(0) || 'feeds' || chr(0)), 32) AS edge_id, namespace_id AS source_namespace_id, target_namespace_id, 'feeds' AS relation_type, domain_id FROM t""",
)
def integration_edges(spark, sf_dir):
    described = namespaces.registry(_described(spark, sf_dir))
    null = F.lit(None).cast("string")
    target = F.struct(F.lit("encargos_sigef").alias("domain_id"), *[null.alias(c) for c in namespaces.SCOPE[1:]])
    spec = F.when(F.col("evidence_type") == "code", F.array(F.struct(F.lit("feeds").alias("relation_type"), target.alias("target"))))
    _, edges = namespaces.edges(described.withColumn("integration_edges", spec))
    return edges.select("edge_id", "source_namespace_id", "target_namespace_id", "relation_type", "domain_id")


@query("metadata_merge", "SELECT page_id, 'page-' || page_id AS title, url AS source_uri, CASE WHEN page_id % 2 = 0 THEN 'reviewed' ELSE 'new' END AS state FROM pages")
def metadata_merge(spark, sf_dir):
    """Source metadata overlaid by block metadata: the right side wins."""
    pages = corpus.table(spark, sf_dir, "pages")
    left = F.create_map(F.lit("title"), corpus.text_of("page-", F.col("page_id")), F.lit("state"), F.lit("new"))
    right = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("state"), F.lit("reviewed"), F.lit("source_uri"), F.col("url"))).otherwise(F.create_map(F.lit("source_uri"), F.col("url")))
    merged = F.map_concat(left, right)
    return pages.select("page_id", merged["title"].alias("title"), merged["source_uri"].alias("source_uri"), merged["state"].alias("state"))


@query(
    "embedding_upsert",
    """SELECT vec_id, 'space-' || label % 3 AS embedding_space_id, CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS seq, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END, 4) AS total FROM embeddings""",
)
def embedding_upsert(spark, sf_dir):
    """Vectors saved again replace those of the same chunk and space; the others stay."""
    rows = corpus.table(spark, sf_dir, "embeddings").select("vec_id", "label", corpus.text_of("space-", F.col("label") % 3).alias("embedding_space_id"), F.col("embedding").cast("array<double>").alias("vector"))
    again = rows.where("label % 2 = 0").withColumn("vector", F.transform("vector", lambda x: x * 2))
    merged = store.upsert(rows.withColumn("seq", F.lit(1).cast("long")), again.withColumn("seq", F.lit(2).cast("long")), ["vec_id", "embedding_space_id"], "seq")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return merged.select("vec_id", "embedding_space_id", "seq", F.round(total, 4).alias("total"))


@query(
    "store_replay_old_batch",
    """WITH v AS (SELECT 'conv-' || conv_id AS source_id, sha256(text) AS content_hash, min(turn) AS first_turn FROM conversations GROUP BY ALL)
 SELECT source_id, content_hash, row_number() OVER (PARTITION BY source_id ORDER BY first_turn) AS version_number, first_turn = max(first_turn) OVER (PARTITION BY source_id) AS latest FROM v""",
)
def store_replay_old_batch(spark, sf_dir):
    """Versions after two batches and a replay of the first: numbers keep the order of arrival, the newest stays current."""
    import uuid

    from attesta.plans.ingest import ingest
    from attesta.session import shared_checkpoint_dir

    kept = store.EvidenceStore(spark, f"{shared_checkpoint_dir(spark)}/attesta-store-{uuid.uuid4().hex}")
    turns = corpus.table(spark, sf_dir, "conversations").select(
        corpus.text_of("conv-", F.col("conv_id")).alias("source_id"), corpus.text_of("chat/", F.col("conv_id")).alias("source_uri"), F.col("text").alias("content"),
        F.timestamp_seconds(F.col("turn")).alias("arrival"), "turn",
    )
    for batch, part in (("b1", turns.where("turn < 2")), ("b2", turns.where("turn >= 2")), ("b1", turns.where("turn < 2"))):
        ingest(kept, part.drop("turn"), batch)
    current = kept.current("sources").select("source_id", F.col("content_hash").alias("current_hash"))
    versions = kept.read("source_versions").select("source_id", "content_hash", F.col("version_number").cast("long").alias("version_number"))
    return versions.join(current, "source_id").select("source_id", "content_hash", "version_number", (F.col("content_hash") == F.col("current_hash")).alias("latest"))
