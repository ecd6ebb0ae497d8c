"""Evidence packages: ranked hits grouped by source version, with provenance references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import ids
from attesta.functions import text as T

PACKAGE_KEYS = ["score", "source_version_id", "package_id"]


def statement(text: Column, locator: Column) -> Column:
    """First line of the evidence, or its locator when the text is blank."""
    return F.when(T.strip(text) == "", locator).otherwise(T.first_line(text))


def evidence_reference(query: str, mode: str) -> Column:
    """Reference struct of one hit."""
    return F.struct(
        ids.scoped_id("eref", F.col("source_id"), F.col("source_version_id"), F.col("locator"), F.lit(mode), F.lit(query)).alias("reference_id"),
        F.col("chunk_id"),
        F.col("source_id"),
        F.col("source_version_id"),
        F.col("locator"),
        F.lit("retrieval").alias("role"),
        F.concat(F.col("source_id"), F.lit(":"), F.col("locator")).alias("provenance_ref"),
        F.col("chunk_hash").alias("excerpt_hash"),
        statement(F.col("text"), F.col("locator")).alias("statement"),
        F.col("score"),
    )


def package_hits(hits: DataFrame, query: str, mode: str) -> DataFrame:
    """One package per source version.

    ``hits`` is already limited to the request's top-k, which bounds every group. References
    keep the rank order (-score, ordinal, chunk_id); the first is the primary hit and lends the
    package its scope columns.
    """
    scope = [c for c in ("source_id", "namespace_id", "domain_id", "system_id", "component_id", "evidence_type", "source_type", "locator", "lexical_score", "semantic_score") if c in hits.columns]
    position = F.struct((-F.col("score")).alias("s"), F.col("ordinal").alias("o"), F.col("chunk_id").alias("c"))
    member = F.struct(position.alias("at"), evidence_reference(query, mode).alias("ref"), F.struct(*scope).alias("scope"))
    neighbors = F.flatten(F.array_sort(F.collect_list(F.struct(position.alias("at"), F.col("neighboring_chunk_ids").alias("n"))))["n"]) if "neighboring_chunk_ids" in hits.columns else F.array().cast("array<string>")
    grouped = hits.groupBy("source_version_id").agg(
        F.array_sort(F.collect_list(member)).alias("members"),
        F.sum(T.estimated_tokens(F.col("text"))).alias("estimated_tokens"),
        F.sum(T.estimated_bytes(F.col("text"))).alias("estimated_bytes"),
        F.array_distinct(neighbors).alias("neighboring_chunk_ids"),
    )
    primary = F.col("members")[0]
    return grouped.select(
        ids.scoped_id("pkg", F.lit(query), F.lit(mode), F.col("source_version_id")).alias("package_id"),
        F.lit(query).alias("query"),
        F.lit(mode).alias("retrieval_mode"),
        "source_version_id",
        *[primary["scope"][c].alias(c) for c in scope],
        (-primary["at"]["s"]).alias("score"),
        "estimated_tokens",
        "estimated_bytes",
        "neighboring_chunk_ids",
        F.col("members")["ref"].alias("evidence_refs"),
    )


def package_order() -> list[Column]:
    return [F.col("score").desc(), F.col("source_version_id"), F.col("package_id")]


def package_totals(packages: DataFrame) -> DataFrame:
    return packages.agg(
        F.count(F.lit(1)).alias("package_count"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_tokens"),
        F.coalesce(F.sum("estimated_bytes"), F.lit(0)).alias("estimated_bytes"),
    )
