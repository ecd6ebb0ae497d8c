"""Hash-chained audit records.

Appending to a chain is sequential by definition, so it runs as stateful streaming (see
:mod:`attesta.streaming.chain`). Verification is not: every record is checked on its own plus
one join on the previous hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.ids import sha256_hex

# Fixed values.
GENESIS = "GENESIS"


def json_string(value: Column) -> Column:
    """A JSON string literal with non-ASCII characters escaped, as canonical JSON has it."""
    return F.substring(F.to_json(F.struct(value.cast("string").alias("v"))), F.lit(6), F.char_length(F.to_json(F.struct(value.cast("string").alias("v")))) - 6)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with sorted keys from already encoded values."""
    parts: list[Column] = []
    for key in sorted(fields):
        parts += [F.lit(("," if parts else "{") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def record_hash(action: Column, correlation_id: Column, fields: Column, previous: Column) -> Column:
    """Digest of one record; ``fields`` is canonical JSON text."""
    body = canonical_json({"action": json_string(action), "correlation_id": json_string(correlation_id), "fields": fields, "previous_hash": json_string(previous)})
    return sha256_hex(body)


def verify(chain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records with what is wrong with them: own digest, missing predecessor, or a fork.

    ``chain`` has ``action, correlation_id, fields, previous_hash, record_hash``. Joins are on
    the hash, which is unique, so a dominant chain key skews nothing.
    """
    expected = record_hash(F.col("action"), F.col("correlation_id"), F.col("fields"), F.col("previous_hash"))
    known = chain.select(*keys, F.col("record_hash").alias("previous_hash")).distinct().withColumn("_known", F.lit(True))
    successors = chain.groupBy(*keys, "previous_hash").agg(F.count(F.lit(1)).alias("_successors"))
    checked = chain.withColumn("_ok", expected == F.col("record_hash")).join(known, [*keys, "previous_hash"], "left").join(successors, [*keys, "previous_hash"])
    problem = (
        F.when(~F.col("_ok"), F.lit("digest mismatch"))
        .when(F.col("_known").isNull() & (F.col("previous_hash") != GENESIS), F.lit("missing predecessor"))
        .when(F.col("_successors") > 1, F.lit("fork"))
    )
    return checked.withColumn("problem", problem).drop("_ok", "_known", "_successors")
