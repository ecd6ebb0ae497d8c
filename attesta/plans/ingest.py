"""Ingestion: sources to versions, artifacts, chunks, embeddings and code index.

The plan is one pass over the raw texts. Chunking is the only Python step before redaction,
and embedding sees redacted text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import ids, redact
from attesta.functions import vectors as V
from attesta.functions.text import chunk_locator
from attesta.operators import code_index, namespaces
from attesta.operators.ranking import first_per_key
from attesta.operators.store import EvidenceStore, version_numbers
from attesta.session import cut_lineage
from attesta.sources import blocks as B

# Scope defaults of an ingest call.
DEFAULTS = {
    "source_kind": "document", "channel": "manual", "domain_id": "general", "system_id": "unknown", "environment": "unknown",
    "acl_scope": "internal", "source_type": "document", "mime_type": "text/plain", "parser_name": "identity", "parser_version": "1",
}
# Versions of one source that arrive within this many microseconds are numbered by one task.
ARRIVAL_BUCKET = 24 * 3_600_000_000
SCOPE = ["namespace_id", "domain_id", "system_id", "component_id", "environment", "evidence_type", "acl_scope"]


def prepare_sources(raw: DataFrame) -> DataFrame:
    """Fill defaults, redact metadata and URI, derive hashes, ids and the namespace."""
    given = set(raw.columns)
    filled = raw.withColumns(
        {c: (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) if c in given else F.lit(d)) for c, d in DEFAULTS.items()}
    )
    metadata = F.col("metadata") if "metadata" in given else F.create_map().cast("map<string,string>")
    metadata = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    filled = filled.withColumns({"secrets": redact.sensitive_values(metadata), "metadata": redact.redact_metadata(metadata)})
    optional = lambda c: F.nullif(F.col(c), F.lit("")) if c in given else F.lit(None).cast("string")
    component = F.coalesce(optional("component_id"), F.try_element_at(F.col("metadata"), F.lit("component_id")))
    scoped = filled.withColumns(
        {
            "source_uri": redact.redact_text(F.col("source_uri"), F.col("secrets")),
            "component_id": namespaces.hinted(component, "component_id", "unknown-component"),
            "evidence_type": F.coalesce(optional("evidence_type"), F.col("source_type"), F.col("source_kind")),
            "content_hash": ids.content_hash("content"),
            "size_bytes": F.octet_length("content").cast("long"),
        }
    )
    n = F.col
    return scoped.withColumns(
        {
            "namespace_id": ids.namespace_id(*[n(c) for c in SCOPE[1:]]),
            "source_version_id": ids.source_version_id(n("source_id"), n("content_hash"), n("parser_version")),
            "artifact_hash": ids.artifact_hash(n("content_hash"), n("parser_version")),
        }
    )


def chunk_rows(prepared: DataFrame, blocks: Column | None = None) -> DataFrame:
    """Redacted chunks of prepared sources, with identity and locator.

    ``blocks`` defaults to packing ``content``; parsers pass their own block array, whose
    ``locator`` and ``page`` win over the computed ones.
    """
    own = blocks is not None
    packed = blocks if own else B.chunk_blocks(F.col("content").cast("string"))
    carried = ["source_id", "source_version_id", "artifact_hash", *SCOPE, "source_type", "source_uri", "parser_version", "secrets", "metadata"]
    if "ingest_ts" in prepared.columns:
        carried.append("ingest_ts")
    kept = prepared.select(*carried, packed.alias("_blocks"))
    rows = kept.select(*carried, F.explode("_blocks").alias("b"))
    text = redact.redact_text(F.col("b.text"), F.col("secrets"))
    locator = chunk_locator(F.col("source_uri"), F.col("b.ordinal"), F.col("b.line_start"), F.col("b.line_end"))
    if own:
        locator = F.coalesce(redact.redact_text(F.col("b.locator"), F.col("secrets")), locator)
    shaped = rows.select(
        *[c for c in carried if c != "secrets"],
        F.col("b.ordinal").cast("long").alias("ordinal"), text.alias("text"), locator.alias("locator"),
        (F.col("b.page") if own else F.lit(None).cast("int")).alias("page"), F.col("b.line_start").alias("line_start"), F.col("b.line_end").alias("line_end"),
        *([redact.redact_metadata(F.coalesce(F.col("b.metadata"), F.create_map().cast("map<string,string>"))).alias("_block")] if own else []),
    )
    if own:
        shaped = shaped.withColumn("metadata", F.map_concat("metadata", "_block")).drop("_block")
    version, ordinal = F.col("source_version_id"), F.col("ordinal")
    return shaped.withColumns({"chunk_id": ids.chunk_id(version, ordinal), "chunk_hash": ids.chunk_hash(version, ordinal, F.col("text"))})


def embedding_rows(chunks: DataFrame, space: str, purpose: str = "retrieval_document") -> DataFrame:
    """Hashing embeddings of redacted chunk text in one space (``model:dimension:revision``)."""
    model, dimension, revision = space.rsplit(":", 2)
    return chunks.select(
        "chunk_id", "source_version_id", F.lit(space).alias("embedding_space_id"), F.lit(model).alias("model"), F.lit(int(dimension)).alias("dimensions"),
        V.hash_embedding(F.col("text"), int(dimension)).alias("vector"), F.lit("LOCAL").alias("provider"), F.lit(revision).alias("model_revision"),
        F.lit(True).alias("normalized"), F.lit(purpose).alias("purpose"),
    )


def ingest(store: EvidenceStore, raw: DataFrame, batch: str, space: str = "hash-768:768:v1", blocks: Column | None = None) -> DataFrame:
    """Ingest raw sources (``source_id, source_uri, content`` plus scope) into the store.

    Versions of a source are numbered in order of arrival: by the column ``arrival`` (a number),
    else ``modified_at``, else the ingest time. The prepared sources feed seven tables, so they
    are checkpointed once. Returns the versions with their ``created`` flag.
    """
    stamped = raw if "ingest_ts" in raw.columns else raw.withColumn("ingest_ts", F.current_timestamp())
    carried = stamped if blocks is None else stamped.withColumn("_parsed", blocks)
    arrival = next((c for c in ("arrival", "modified_at", "ingest_ts") if c in carried.columns), None)
    arrived = carried.withColumn("_arrival", F.unix_micros(F.col(arrival).cast("timestamp")))
    # of equal versions the first to arrive stays, and its metadata with it
    prepared = cut_lineage(first_per_key(prepare_sources(arrived), ["source_version_id"], ["_arrival", "source_uri"]))
    stored = store.read("source_versions").select("source_id", "content_hash", F.col("version_number").alias("seq"), "batch")
    seen = stored.where(F.col("batch") != batch)
    # a replay keeps the numbers that its first run gave; its own partition is about to be replaced
    own = cut_lineage(stored.where(F.col("batch") == batch).groupBy("source_id", "content_hash").agg(F.min("seq").alias("version_number")))
    known = seen.groupBy("source_id", "content_hash").agg(F.min("seq").alias("version_number"))
    known = known.unionByName(own.join(known, ["source_id", "content_hash"], "left_anti"))
    arriving = prepared.groupBy("source_id", "content_hash").agg(F.min("_arrival").alias("seq")).join(known, ["source_id", "content_hash"], "left_anti")
    base = stored.groupBy("source_id").agg(F.max("seq").alias("_base"))
    numbers = version_numbers(arriving, bucket_rows=ARRIVAL_BUCKET).join(base, "source_id", "left").select("source_id", "content_hash", (F.coalesce("_base", F.lit(0)) + F.col("version_number")).alias("version_number"))
    versions = prepared.join(numbers.unionByName(known), ["source_id", "content_hash"]).withColumn("object_key", F.col("content_hash"))
    chunks = cut_lineage(chunk_rows(prepared, None if blocks is None else F.col("_parsed")))
    source_text = prepared.withColumn("content", F.col("content").cast("string"))
    symbols = code_index.symbols(source_text.select("source_id", "source_version_id", "source_uri", "content", *SCOPE), chunks)
    bundle = {
        "sources": versions.withColumn("_order", F.col("version_number")).withColumns({"created_at": F.col("ingest_ts"), "updated_at": F.col("ingest_ts")}),
        "source_versions": versions,
        "artifacts": prepared.withColumn("object_key", F.col("content_hash")),
        "chunks": chunks,
        "embeddings": embedding_rows(chunks, space),
        "code_symbols": symbols,
        "code_relationships": code_index.relationships(symbols),
        "objects": prepared.select("content_hash", F.col("content").cast("binary").alias("content"), "size_bytes", "mime_type", F.lit(0).cast("long").alias("seq")),
        "namespaces": namespaces.registry(prepared),
    }
    return store.save_bundle(bundle, batch)
