"""Namespace registry and integration edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import ids, redact
from attesta.functions.text import strip
from attesta.operators.ranking import first_per_key
from attesta.sources.corpus import DOMAINS

# Hints of the registered domains, by rule.
HINTS = {
    "system_id": {d: f"{d}_casework" for d in DOMAINS},
    "component_id": {d: f"{d}_evidence" for d in DOMAINS},
    "environment": {d: "prod" for d in DOMAINS},
    "evidence_type": {d: "document" for d in DOMAINS},
    "acl_scope": {d: "internal" for d in DOMAINS},
}
FALLBACKS = {"system_id": "unknown-system", "component_id": "unknown-component", "environment": "unknown", "evidence_type": "document", "acl_scope": "internal"}
SCOPE = ["domain_id", "system_id", "component_id", "environment", "evidence_type", "acl_scope"]


def _blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def hinted(value: Column, field: str, fallback: str, domain: str = "domain_id") -> Column:
    """The value, else the hint of its domain, else the fallback."""
    table = F.create_map(*[F.lit(x) for kv in HINTS[field].items() for x in kv])
    return F.coalesce(_blank_to_null(value), F.try_element_at(table, F.col(domain)), F.lit(fallback))


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def describe(rows: DataFrame) -> DataFrame:
    """Complete scope, names, summary and id of namespace candidates."""
    evidence = F.coalesce(_blank_to_null(_column(rows, "evidence_type")), _blank_to_null(_column(rows, "source_type")))
    scoped = rows.withColumns({f: hinted(evidence if f == "evidence_type" else _column(rows, f), f, FALLBACKS[f]) for f in FALLBACKS})
    c = F.col
    default_summary = F.concat(c("domain_id"), F.lit("/"), c("system_id"), F.lit("/"), c("component_id"), F.lit(" ["), c("evidence_type"), F.lit("] in "), c("environment"))
    summary = F.coalesce(_blank_to_null(redact.redact_text(_column(rows, "summary"))), default_summary)
    uri = _blank_to_null(_column(rows, "source_uri"))
    return scoped.withColumns(
        {
            "namespace_id": ids.namespace_id(*[c(x) for x in SCOPE]),
            "asset_name": F.coalesce(_blank_to_null(redact.redact_text(_column(rows, "asset_name"))), c("domain_id")),
            "component_name": F.coalesce(_blank_to_null(redact.redact_text(_column(rows, "component_name"))), c("component_id")),
            "sanitized_summary": F.when(uri.isNotNull(), F.concat(summary, F.lit(" :: "), redact.redact_text(uri))).otherwise(summary),
        }
    )


def registry(rows: DataFrame, order: str = "sanitized_summary") -> DataFrame:
    """One row per namespace; the description with the smallest ``order`` represents it."""
    described = describe(rows).select("namespace_id", *SCOPE, "asset_name", "component_name", "sanitized_summary")
    return first_per_key(described, ["namespace_id"], [order])


def edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target namespaces and edges from ``integration_edges`` specifications.

    ``rows`` are described namespaces with ``integration_edges ARRAY<STRUCT<relation_type,
    target STRUCT<domain_id, system_id, component_id, environment, evidence_type, acl_scope>>>``.
    Missing target fields inherit the source's; an edge carries its source's scope.
    """
    spec = rows.select("namespace_id", *SCOPE, F.explode("integration_edges").alias("e"))
    target = {f"t_{f}": F.coalesce(_blank_to_null(F.col(f"e.target.{f}")), F.col(f)) for f in SCOPE}
    placed = spec.withColumns(target).withColumn("target_namespace_id", ids.namespace_id(*[F.col(f"t_{f}") for f in SCOPE]))
    relation = F.coalesce(_blank_to_null(F.col("e.relation_type")), F.lit("integrates-with"))
    linked = placed.withColumns({"relation_type": relation, "source_namespace_id": F.col("namespace_id")})
    edge_rows = linked.withColumn("edge_id", ids.edge_id(F.col("source_namespace_id"), F.col("target_namespace_id"), F.col("relation_type"))).select(
        "edge_id", "source_namespace_id", "target_namespace_id", "relation_type", *SCOPE
    )
    targets = registry(linked.select(*[F.col(f"t_{f}").alias(f) for f in SCOPE]))
    return targets, edge_rows.dropDuplicates(["edge_id"])
