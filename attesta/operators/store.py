"""Evidence tables: schemas, idempotent writes, latest-wins views, status and provenance.

Tables are append-only Parquet logs. A write never touches existing files: every batch owns
one ``batch`` partition and replaces only that, so replaying a batch after a failure is
idempotent. Mutable entities are read through a latest-wins view over ``_seq``: the time a batch
was first written, plus the row's ``_order`` within the batch in microseconds. A replay keeps the
time of the first write, so an old batch never overtakes a newer one.

``source_versions`` is the marker of a batch and written last. Rows that a version owns count
only when their batch has its marker, so a batch that broke off is neither read nor taken as
stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.filters import RetrievalFilters, admin_visible, source_status
from attesta.operators.ranking import first_per_key, latest_per_key, numbered_within
from attesta.schemas import IMMUTABLE, KEYS, LOOKUP_COLUMNS, PARTITIONS, TABLES, VERSION_OWNED, table_schema
from attesta.session import cut_lineage, prepare


def put_objects(existing: DataFrame, incoming: DataFrame, key: str = "content_hash", order: str = "seq") -> DataFrame:
    """Content-addressed put: the incoming objects that are not stored yet, one per key."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    return first_per_key(fresh, [key], [order])


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str, keep_earliest: Sequence[str] = ()) -> DataFrame:
    """Last writer wins per key; ``keep_earliest`` columns keep their smallest value."""
    merged = existing.unionByName(incoming)
    rest = [c for c in merged.columns if c not in keys]
    aggregates = [F.max_by(F.struct(*rest), F.col(order)).alias("_row")] + [F.min(c).alias(f"_first_{c}") for c in keep_earliest]
    picked = merged.groupBy(*keys).agg(*aggregates)
    values = [F.col(f"_first_{c}").alias(c) if c in keep_earliest else F.col(f"_row.{c}").alias(c) for c in rest]
    return picked.select(*keys, *values)


def version_numbers(observed: DataFrame, order: str | None = "seq", bucket_rows: int = 65_536) -> DataFrame:
    """Number the distinct contents of each source in the order they were first seen.

    ``observed`` has ``source_id, content_hash`` and an integer ``order``; without one the
    contents count as simultaneous and are numbered by hash. Repeats collapse map-side first
    and the numbering is bucketed, so one huge source is still many tasks.
    """
    keys = ["source_id", "content_hash"]
    if order is None:
        bucket = F.conv(F.substring("content_hash", 1, 4), 16, 10).cast("long")
        return numbered_within(observed.select(*keys).distinct(), ["source_id"], ["content_hash"], bucket, "version_number")
    first = observed.groupBy(*keys).agg(F.min(order).alias("first_seen"))
    bucket = F.expr(f"first_seen div {int(bucket_rows)}")
    return numbered_within(first, ["source_id"], ["first_seen", "content_hash"], bucket, "version_number")


def chunk_guard(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings of known chunks; the rest would dangle."""
    return embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame, target_space: str) -> DataFrame:
    """Chunks that still need a vector in the target space (resumable by construction)."""
    done = embeddings.where(F.col("embedding_space_id") == target_space).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti")


def statuses(sources: DataFrame, versions: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Version, chunk and embedding-space counts per source.

    Each fact table is aggregated to one row per source before it is joined, so no join fans
    out into another's counts.
    """
    per_version = versions.groupBy("source_id").agg(F.count_distinct("source_version_id").alias("versions"))
    per_chunk = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))
    owned = chunks.select("chunk_id", "source_id").join(embeddings.select("chunk_id", "embedding_space_id"), "chunk_id")
    per_space = owned.groupBy("source_id").agg(F.sort_array(F.collect_set("embedding_space_id")).alias("embedding_space_ids"))
    joined = sources.join(per_version, "source_id", "left").join(per_chunk, "source_id", "left").join(per_space, "source_id", "left")
    return joined.withColumns(
        {
            "versions": F.coalesce("versions", F.lit(0)).cast("long"),
            "chunks": F.coalesce("chunks", F.lit(0)).cast("long"),
            "embedding_space_ids": F.coalesce("embedding_space_ids", F.array().cast("array<string>")),
        }
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    return latest_per_key(versions, ["source_id"], ["version_number"])


def provenance(versions: DataFrame, artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Latest version of every source with its artifact and its chunk rows, one row per chunk."""
    latest = latest_versions(versions)
    return latest.join(artifacts, "artifact_hash", "left").join(chunks, "source_version_id", "left")


@dataclass
class EvidenceStore:
    """The evidence tables below one root folder on shared storage."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        prepare(self.spark)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """Every appended row of a table; an empty frame when nothing was written yet."""
        schema = table_schema(name)
        try:
            stored = self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)
        return stored

    def current(self, name: str) -> DataFrame:
        """Latest row per primary key; source creation times survive later upserts.

        Content-addressed tables are returned as stored: their keys never repeat.
        """
        rows = self.read(name)
        if name in VERSION_OWNED:
            marked = self.read("source_versions").select("batch").distinct()  # one row for each batch, from partition values
            return rows.join(marked, "batch", "left_semi").select(*rows.columns)
        if name in IMMUTABLE:
            return rows
        if name != "sources":
            return latest_per_key(rows, KEYS[name], ["_seq"])
        rest = [c for c in rows.columns if c not in KEYS[name]]
        picked = rows.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*rest), "_seq").alias("_row"), F.min("created_at").alias("_created"))
        return picked.select(*KEYS[name], *[F.col("_created").alias(c) if c == "created_at" else F.col(f"_row.{c}").alias(c) for c in rest])

    def append(self, name: str, rows: DataFrame, batch: str) -> None:
        """Write one batch; a replay of the same batch replaces its own output only.

        ``_order`` (optional, from 0) orders the rows of the batch; rows may also bring their own ``_seq``.
        """
        schema = table_schema(name)
        given = set(rows.columns)
        first = self.read(name).where(F.col("batch") == batch).agg(F.min("_seq")).first()[0]
        written = F.lit(first).cast("timestamp") if first is not None else F.current_timestamp()
        place = F.coalesce(F.col("_order"), F.lit(0)) if "_order" in given else F.lit(0)
        own = {"_seq": written + F.make_dt_interval(secs=(place / F.lit(1_000_000)).cast("decimal(18,6)")), "batch": F.lit(batch)}
        shaped = rows.select(*[(F.col(f.name) if f.name in given else own.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.fields])
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        for column in LOOKUP_COLUMNS.get(name, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.partitionBy("batch", *PARTITIONS.get(name, [])).parquet(self._path(name))

    def save_bundle(self, bundle: dict[str, DataFrame], batch: str) -> DataFrame:
        """Store the versions that are new by (source, content, parser) with everything they own.

        Returns the incoming versions with a ``created`` flag. Rows of other tables follow their
        version by semi-join; sources are written last-writer-wins.
        """
        keys = ["source_id", "content_hash", "parser_version"]
        stored = self.read("source_versions").where(F.col("batch") != batch).select(*keys).distinct().withColumn("_old", F.lit(True))
        flagged = first_per_key(bundle["source_versions"], keys, ["source_version_id"]).join(stored, keys, "left")
        flagged = cut_lineage(flagged.withColumn("created", F.col("_old").isNull()).drop("_old"))
        fresh = flagged.where("created")
        for name, rows in bundle.items():
            if name == "sources":
                self.append(name, rows.join(fresh.select("source_id").distinct(), "source_id", "left_semi"), batch)
            elif name == "objects":
                self.append(name, put_objects(self.read("objects").where(F.col("batch") != batch), rows), batch)
            elif name in ("namespaces", "integration_edges"):
                self.append(name, rows, batch)
            elif name != "source_versions":
                self.append(name, rows.join(fresh.select("source_version_id"), "source_version_id", "left_semi"), batch)
        self.append("source_versions", fresh.drop("created"), batch)  # the marker: only now does the batch count
        return flagged

    def save_embeddings(self, rows: DataFrame, batch: str) -> None:
        self.append("embeddings", chunk_guard(rows, self.current("chunks")), batch)

    def get_objects(self, keys: DataFrame) -> DataFrame:
        return self.read("objects").join(keys.select("content_hash").distinct(), "content_hash", "left_semi")

    def list_sources(self, filters: RetrievalFilters, include_retired: bool = False) -> DataFrame:
        visible = self.current("sources").where(admin_visible(filters, include_retired))
        return visible.withColumn("status", source_status()).orderBy("source_id")

    def status(self, filters: RetrievalFilters) -> DataFrame:
        visible = self.current("sources").where(admin_visible(filters, include_retired=True)).select("source_id", "domain_id", "acl_scope", source_status().alias("status"))
        return statuses(visible, self.read("source_versions"), self.current("chunks"), self.current("embeddings"))

    def provenance(self, filters: RetrievalFilters) -> DataFrame:
        visible = self.current("sources").where(admin_visible(filters, include_retired=True)).select("source_id")
        versions = self.current("source_versions").join(visible, "source_id", "left_semi")
        artifacts = self.current("artifacts").select("artifact_hash", "mime_type", "parser_name", "size_bytes")
        chunks = self.current("chunks").select("source_version_id", "chunk_id", "ordinal", "locator")
        return provenance(versions, artifacts, chunks)

    def migrate(self) -> list[str]:
        """Record the schema of every table; refuse to work on tables written under another one.

        Returns the tables recorded now. A recorded checksum that differs from the current
        schema means the stored files do not match this version of the package.
        """
        wanted = {name: hashlib.sha256(table_schema(name).json().encode()).hexdigest() for name in TABLES if name != "schema_migrations"}
        recorded = {r.version: r.checksum for r in self.read("schema_migrations").select("version", "checksum").distinct().collect()}
        drifted = sorted(n for n, checksum in recorded.items() if wanted.get(n) != checksum)
        if drifted:
            raise RuntimeError(f"stored schema differs for {drifted}")
        new = sorted(set(wanted) - set(recorded))
        if new:
            rows = self.spark.createDataFrame([(n, wanted[n]) for n in new], "version string, checksum string")
            self.append("schema_migrations", rows.withColumn("applied_at", F.current_timestamp()), f"migration-{len(recorded)}")
        return new

    def snapshot(self, target: str) -> None:
        """Copy every non-empty table to another root."""
        copy = EvidenceStore(self.spark, target)
        for name in TABLES:
            copy.append(name, (self.current(name) if name in VERSION_OWNED else self.read(name)).drop("batch"), "snapshot")

    def compact(self, name: str, target: str, file_bytes: int = 256 * 1024 * 1024) -> None:
        """Rewrite the current rows of one table below another root in files of about one size.

        Rows are range-partitioned by partition column and key, so a large partition value
        spans many tasks and the key statistics of the files become selective.
        """
        rows = self.current(name).drop("batch")
        size = int(self.read(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        placed = rows.repartitionByRange(max(1, size // file_bytes), *PARTITIONS.get(name, []), *KEYS[name])
        EvidenceStore(self.spark, target).append(name, placed, "compacted")


def with_legacy_defaults(sources: DataFrame) -> DataFrame:
    """Fill the scope columns that older snapshots did not carry, in dependency order."""

    def value(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in sources.columns else F.lit(None).cast("string")

    domain = F.coalesce(value("domain_id"), value("domain"), F.lit("general"))
    system = F.coalesce(value("system_id"), value("system"), F.lit("unknown"))
    evidence = F.coalesce(value("evidence_type"), value("source_type"), F.lit("document"))
    return sources.withColumns(
        {
            "namespace_id": F.coalesce(value("namespace_id"), F.concat(F.lit("ns_"), F.coalesce(F.col("source_id"), F.lit("")))),
            "domain_id": domain,
            "system_id": system,
            "component_id": F.coalesce(value("component_id"), value("system_id"), F.lit("unknown-component")),
            "evidence_type": evidence,
            "source_type": F.coalesce(value("source_type"), evidence),
        }
    )
