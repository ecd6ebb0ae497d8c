"""Read-only diagnostics: signed jobs, bounded outputs, and outputs as evidence."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Mapping
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import guards
from attesta.functions.text import splitlines, strip

# Output limits.
MAX_ROWS = 500
MAX_RUNTIME_SECONDS = 30.0
MAX_OUTPUT_BYTES = 64_000


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=lambda v: v.isoformat() if isinstance(v, datetime) else str(v))


def sign(payload: Mapping[str, object], secret: bytes) -> tuple[str, str]:
    """Payload hash and its HMAC-SHA256 signature."""
    digest = hashlib.sha256(canonical_json(payload).encode()).hexdigest()
    return digest, hmac.new(secret, digest.encode(), hashlib.sha256).hexdigest()


def verify(payload: Mapping[str, object], payload_hash: str, signature: str, secret: bytes) -> bool:
    digest, expected = sign(payload, secret)
    return hmac.compare_digest(digest, payload_hash) and hmac.compare_digest(expected, signature)


def create_job(request: Mapping[str, object], sql: str, secret: bytes, operation: str = "read_select") -> dict[str, object]:
    """A signed job for a checked read-only statement."""
    if operation not in ("read_select", "describe"):
        raise PermissionError("diagnostic operation is not read-only")
    leaked = [k for scope in (request, request.get("metadata") or {}) for k in scope if k in guards.FORBIDDEN_SECRET_KEYS]
    if leaked:
        raise PermissionError(f"secret material is not accepted: {leaked}")
    reason = guards.rejection_reason(sql)
    if reason:
        raise ValueError(f"statement rejected: {reason}")
    payload = {**request, "operation_class": operation, "sql_text": sql.strip(), "max_rows": MAX_ROWS, "max_runtime_seconds": MAX_RUNTIME_SECONDS, "max_output_bytes": MAX_OUTPUT_BYTES}
    payload_hash, signature = sign(payload, secret)
    return {**payload, "payload_hash": payload_hash, "signature": signature, "status": "pending"}


def cut_bytes(text: Column, max_bytes: int) -> Column:
    """Longest prefix of whole characters within ``max_bytes`` of UTF-8."""

    @F.arrow_udf("string")
    def cut(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.encode()[:max_bytes].decode("utf-8", "ignore") for v in values.to_pylist()], pa.string())

    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(cut(text))


def bound_outputs(outputs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """Cut outputs (``stdout, output_format``) by rows, then by bytes, and flag the cut.

    CSV keeps its header and is always rejoined without blank lines; other formats keep their
    text unless rows had to go.
    """
    lines = F.filter(splitlines(F.col("stdout")), lambda ln: strip(ln) != "")
    is_csv = F.col("output_format") == "csv"
    prepared = outputs.withColumn("_lines", lines).withColumn("_n", F.when(is_csv, F.greatest(F.size("_lines") - 1, F.lit(0))).otherwise(F.size("_lines")))
    many = F.col("_n") > max_rows
    kept = F.slice("_lines", F.lit(1), F.when(is_csv, F.lit(max_rows + 1)).otherwise(F.lit(max_rows)))
    rejoined = F.array_join(F.when(many, kept).otherwise(F.col("_lines")), "\n")
    text = F.when((is_csv & (F.size("_lines") > 0)) | many, rejoined).otherwise(F.col("stdout"))
    bounded = prepared.withColumns({"_text": text, "row_count": F.least("_n", F.lit(max_rows)).cast("long")})
    return bounded.withColumns({"truncated": many | (F.octet_length("_text") > max_bytes), "stdout": cut_bytes(F.col("_text"), max_bytes)}).withColumn("stdout_hash", F.sha2("stdout", 256)).drop("_lines", "_n", "_text")


def outputs_as_sources(outputs: DataFrame) -> DataFrame:
    """Diagnostic outputs (``job_id, stdout`` …) as raw sources for :func:`attesta.plans.ingest.ingest`."""
    uri = F.concat(F.lit("diagnostic://jobs/"), F.col("job_id"))
    return outputs.select(
        F.concat(F.lit("diag_"), F.substring(F.sha2("job_id", 256), 1, 32)).alias("source_id"), uri.alias("source_uri"), F.col("stdout").alias("content"), F.lit("query-output").alias("source_type"),
        F.lit("query-output").alias("evidence_type"), F.lit("diagnostic").alias("channel"), F.create_map(F.lit("job_id"), F.col("job_id"), F.lit("stdout_hash"), F.col("stdout_hash")).alias("metadata"),
    )


def execute(job: Mapping[str, object], run: Callable[[str], DataFrame], secret: bytes) -> DataFrame:
    """Run a verified job through an injected runner; its first rows in column order, ``truncated`` if there were more."""
    payload = {k: v for k, v in job.items() if k not in ("payload_hash", "signature", "status")}
    if not verify(payload, str(job["payload_hash"]), str(job["signature"]), secret):
        raise PermissionError("job signature does not match")
    rows, bound = run(str(job["sql_text"])), int(job["max_rows"])
    more = rows.limit(bound + 1).count() > bound
    return rows.orderBy(*rows.columns).limit(bound).withColumn("truncated", F.lit(more))
