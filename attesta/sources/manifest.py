"""Benchmark manifests and release manifests, checked as joins over file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import extract, guards
from attesta.sources.files import scan_files

# Fixed values.
MANIFEST_VERSION = 1
REQUIRED = ["fixture_id", "path", "source_id", "source_type", "domain_id", "acl_scope", "language", "content_sha256"]
MODES = ["lexical", "vector", "hybrid", "symbol_aware"]
MANIFEST_SCHEMA = (
    "manifest_version int, fixture_set string, "
    "default_filters struct<principal_acl_scopes:array<string>,domain_ids:array<string>>, "
    "fixtures array<struct<fixture_id:string,path:string,source_id:string,source_type:string,domain_id:string,system_id:string,acl_scope:string,language:string,mime_type:string,content_sha256:string>>, "
    "queries array<struct<query_id:string,text:string,relevant_source_ids:array<string>,relevant_symbols:array<string>,modes:array<string>>>"
)


class ManifestError(ValueError):
    """A manifest that is incomplete, unsafe or does not match its files."""


def relative_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` relative to the root, ``content``, ``size`` and ``sha256`` of every file."""
    base = root.rstrip("/") + "/"
    files = scan_files(spark, root)
    path = F.substring_index(F.regexp_replace("source_uri", "^file:/+", "/"), base, -1)
    return files.select(path.alias("path"), "content", F.col("size_bytes").alias("size"), F.sha2("content", 256).alias("sha256"))


def load(spark: SparkSession, root: str, name: str = "manifest.json") -> tuple[DataFrame, DataFrame]:
    """Checked ``fixtures`` (with content) and ``queries`` of a manifest below ``root``."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(f"{root}/{name}")
    if manifest.where(F.col("manifest_version") == MANIFEST_VERSION).isEmpty():
        raise ManifestError("unsupported manifest version")
    fixtures, queries = manifest.select(F.inline("fixtures")), manifest.select(F.inline("queries"))
    defaults = manifest.select("default_filters.*")
    joined = fixtures.join(relative_files(spark, root), "path", "left")
    missing = F.lit(False)
    for column in REQUIRED:
        missing = missing | (F.coalesce(F.col(column), F.lit("")) == "")
    problem = (
        F.when(missing, F.lit("missing fields"))
        .when(~guards.is_safe_path(F.col("path")), F.lit("path escapes the manifest directory"))
        .when(F.col("content").isNull(), F.lit("file does not exist"))
        .when(extract.has_secret(F.col("content").cast("string")), F.lit("not sanitized"))
        .when(F.col("sha256") != F.col("content_sha256"), F.lit("hash mismatch"))
    )
    _refuse(joined.select(F.col("fixture_id").alias("id"), problem.alias("problem")))
    for column in ("fixture_id", "source_id"):
        _refuse(fixtures.groupBy(F.col(column).alias("id")).count().where("count > 1").select("id", F.lit("duplicate id").alias("problem")))
    known = fixtures.agg(F.collect_set("source_id").alias("known"))
    checked = queries.withColumn("_k", F.lit(1)).join(known.withColumn("_k", F.lit(1)), "_k").drop("_k")
    allowed = F.array(*[F.lit(m) for m in MODES])
    bad = (
        F.when((F.coalesce("query_id", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == "") | (F.coalesce(F.size("relevant_source_ids"), F.lit(0)) < 1), F.lit("incomplete query"))
        .when(F.size(F.array_except(F.coalesce("modes", allowed), allowed)) > 0, F.lit("unsupported mode"))
        .when(F.size(F.array_except("relevant_source_ids", "known")) > 0, F.lit("unknown source"))
    )
    _refuse(checked.select(F.col("query_id").alias("id"), bad.alias("problem")))
    scope = defaults.withColumn("_k", F.lit(1))
    scoped = queries.withColumn("_k", F.lit(1)).join(scope, "_k").drop("_k").withColumn("modes", F.coalesce("modes", allowed))
    return joined.select(*fixtures.columns, F.col("content").cast("string").alias("content")), scoped


def _refuse(problems: DataFrame) -> None:
    first = problems.where(F.col("problem").isNotNull()).limit(3).collect()
    if first:
        raise ManifestError("; ".join(f"{r.id}: {r.problem}" for r in first))


def release_differences(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Paths on which a release folder and its manifest disagree.

    Both sides have ``path, size, sha256``; an empty result means the release is intact.
    """
    actual = files.where(F.col("path") != "manifest.json").select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    both = actual.join(entries.select("path", "size", "sha256"), "path", "full_outer")
    problem = (
        F.when(F.col("sha256").isNull(), F.lit("not in manifest"))
        .when(F.col("_sha").isNull(), F.lit("file missing"))
        .when((F.col("size") != F.col("_size")) | (F.col("sha256") != F.col("_sha")), F.lit("content differs"))
    )
    return both.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
