"""Evidence corpora derived from a directory of benchmark tables.

The tables carry no access scopes, so scope columns are derived from each row's own key. All
derivations are row-local expressions: they cost no shuffle and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import prepare

# Scope derivation.
DOMAINS = ["criminal", "contraordenacional", "contencioso_administrativo", "contencioso_judicial", "encargos_sigef"]
SOURCE_TYPES = ["document", "log", "code", "schema", "query-output"]
EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One benchmark table; how it is split is left to the scan settings."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _choice(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def scope_columns(key: Column) -> dict[str, Column]:
    return {
        "acl_scope": _choice(key, ["internal", "internal", "team-a", "public"]),
        "component_id": text_of("comp-", key % 7),
        "environment": _choice(key, ["prod", "test", "dev"]),
        "ingest_ts": F.expr(EPOCH) + F.make_dt_interval(mins=key.cast("int")),
    }


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document; language is the domain and the crawl source the system."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return docs.select(
        "doc_id",
        text_of("doc-", key).alias("chunk_id"),
        text_of("doc-", key).alias("source_id"),
        text_of("docv-", key).alias("source_version_id"),
        F.lit(0).cast("long").alias("ordinal"),
        "text",
        text_of("docs/", F.col("source"), "/", key, ".md").alias("source_uri"),
        F.col("lang").alias("domain_id"),
        F.col("source").alias("system_id"),
        _choice(key, SOURCE_TYPES).alias("source_type"),
        _choice(key, SOURCE_TYPES).alias("evidence_type"),
        *[c.alias(n) for n, c in scope_columns(key).items()],
    )


def _evidence(df: DataFrame, prefix: str, key: Column, text: Column, uri: Column, source_type: str) -> DataFrame:
    ident = text_of(f"{prefix}-", key)
    return df.select(
        ident.alias("chunk_id"),
        ident.alias("source_id"),
        text_of(f"{prefix}v-", key).alias("source_version_id"),
        F.lit(0).cast("long").alias("ordinal"),
        text.alias("text"),
        uri.alias("source_uri"),
        text_of(uri, ":L1").alias("locator"),
        F.sha2(text, 256).alias("chunk_hash"),
        _choice(key, DOMAINS).alias("domain_id"),
        text_of("sys-", key % 6).alias("system_id"),
        F.lit(source_type).alias("source_type"),
        F.lit(source_type).alias("evidence_type"),
        *[c.alias(n) for n, c in scope_columns(key).items()],
    )


def event_k() -> Column:
    return F.get_json_object("props", "$.k")


def event_iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application log lines from every event; errors carry a stack frame."""
    events = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    frame = F.when(F.col("event_type") == "error", text_of('\n  File "src/part_', event_k(), '.py", line ', event_k())).otherwise(F.lit(""))
    line = text_of(
        event_iso(), " host-", F.col("user_id") % 5, " request_id=req-", F.col("event_id"), " correlation_id=corr-", F.col("user_id"),
        " ", level, " ", F.col("event_type"), " handled", frame,
    )
    return _evidence(events, "log", F.col("event_id"), line, text_of("logs/app-", F.col("user_id") % 5, ".log"), "log")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row log-search CSV exports from every event."""
    events = table(spark, sf_dir, "events")
    text = text_of("_time,host,message\n", event_iso(), ",host-", F.col("user_id") % 5, ",", F.col("event_type"), " correlation_id=corr-", F.col("user_id"))
    return _evidence(events, "csv", F.col("event_id"), text, text_of("exports/", F.col("event_id"), ".csv"), "splunk-csv")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small module per part."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    text = text_of(
        "import catalog\nclass Part", key, ":\n    def size_", F.col("p_size"), "(self):\n        return load_", F.col("p_size"),
        '("', F.col("p_brand"), '")\ndef load_', F.col("p_size"), "(brand):\n    try:\n        return catalog.find(brand)\n    except KeyError:\n        logger.error(brand)",
    )
    return _evidence(parts, "code", key, text, text_of("repo/src/part_", key, ".py"), "code")


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table definition per supplier."""
    suppliers = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    text = text_of("CREATE TABLE supplier_", key, " (\n  id INT,\n  nation_", F.col("s_nationkey"), " VARCHAR(25)\n);\n-- query path")
    return _evidence(suppliers, "ddl", key, text, text_of("db/supplier_", key, ".sql"), "schema")


def query_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result listing per order; partially shipped orders list no rows."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    row = F.when(F.col("o_orderstatus") == "P", F.lit("-- 0 rows")).otherwise(text_of(key, " | ", F.col("o_orderstatus"), " | ", F.col("o_orderpriority")))
    return _evidence(orders, "out", key, text_of("order_key | status | priority\n-----\n", row), text_of("out/order_", key, ".txt"), "query-output")


def integrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages, headed by their address, as integration definitions."""
    pages = table(spark, sf_dir, "pages")
    return _evidence(pages, "page", F.col("page_id"), text_of(F.col("url"), "\n", F.col("html")), F.col("url"), "integration")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as documentation evidence."""
    docs = table(spark, sf_dir, "documents")
    text = text_of("Controlled verification of ", F.col("source"), "\n", F.col("text"))
    return _evidence(docs, "doc", F.col("doc_id"), text, text_of("docs/", F.col("source"), "/", F.col("doc_id"), ".md"), "document")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence kinds in one table."""
    parts = [f(spark, sf_dir) for f in (logs, exports, code, integrations, schemas, query_outputs, prose)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks: the conversation is the version, the turn the ordinal."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        text_of("turn-", F.col("conv_id"), "-", F.col("turn")).alias("chunk_id"),
        text_of("conv-", F.col("conv_id")).alias("source_version_id"),
        F.col("turn").cast("long").alias("ordinal"),
        "text",
        "role",
        "conv_id",
    )


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, vector`` of the documents that have an embedding."""
    return table(spark, sf_dir, "embeddings").select(text_of("doc-", F.col("vec_id")).alias("chunk_id"), F.col("embedding").alias("vector"))
