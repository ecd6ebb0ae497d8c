"""Content-addressed identifiers as Column expressions.

Two digest layouts exist and must not be mixed: ``joined`` (parts separated by a delimiter)
and ``terminated`` (every part followed by NUL). Which families hash their prefix is part of
the identifier contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier prefixes and digest lengths.
NAMESPACE_DIGEST = 32
SYMBOL_DIGEST = 32
AUDIT_DIGEST = 24


def _c(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _nul() -> Column:
    return F.expr("char(0)")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def terminated_digest(*parts: Column) -> Column:
    """sha256 over each part followed by a NUL byte."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [part.cast("string"), _nul()]
    return sha256_hex(F.concat(*pieces))


def joined_digest(*parts: Column) -> Column:
    """sha256 over the parts separated by NUL bytes, none after the last."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(_nul())
        pieces.append(part.cast("string"))
    return sha256_hex(F.concat(*pieces))


def content_hash(content: Column | str) -> Column:
    return sha256_hex(_c(content))


def source_version_id(source_id: Column, content: Column, parser_version: Column) -> Column:
    key = F.concat(F.lit("source-version:"), source_id, F.lit(":"), content, F.lit(":"), parser_version)
    return F.concat(F.lit("srcver_"), sha256_hex(key))


def artifact_hash(content: Column, parser_version: Column) -> Column:
    return sha256_hex(F.concat(content, F.lit(":"), parser_version))


def chunk_id(version_id: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("chunk_"), sha256_hex(F.concat(F.lit("chunk:"), version_id, F.lit(":"), ordinal.cast("string"))))


def chunk_hash(version_id: Column, ordinal: Column, text: Column) -> Column:
    return sha256_hex(F.concat(version_id, F.lit(":"), ordinal.cast("string"), F.lit(":"), text))


def namespace_id(domain: Column, system: Column, component: Column, environment: Column, evidence: Column, acl: Column) -> Column:
    digest = terminated_digest(domain, system, component, environment, evidence, acl)
    return F.concat(F.lit("ns_"), F.substring(digest, 1, NAMESPACE_DIGEST))


def edge_id(source_namespace: Column, target_namespace: Column, relation: Column) -> Column:
    digest = terminated_digest(source_namespace, target_namespace, relation)
    return F.concat(F.lit("edge_"), F.substring(digest, 1, NAMESPACE_DIGEST))


def index_id(prefix: str, *parts: Column) -> Column:
    """Symbol and relationship ids."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(joined_digest(*parts), 1, SYMBOL_DIGEST))


def ingest_source_id(channel: Column, uri: Column, suffix: Column | None = None) -> Column:
    digest = terminated_digest(channel, uri, suffix if suffix is not None else F.lit(""))
    return F.concat(F.lit("src_"), F.substring(digest, 1, NAMESPACE_DIGEST))


def job_id(channel: Column, source_id: Column, content: Column, parser: Column, parser_version: Column | None = None) -> Column:
    version = F.coalesce(parser_version, F.lit("detected")) if parser_version is not None else F.lit("detected")
    return F.concat(F.lit("job_"), terminated_digest(channel, source_id, content, parser, version))


def audit_id(prefix: str, *parts: Column) -> Column:
    """Finding, evidence-reference, event and audit ids: the prefix is not hashed."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(terminated_digest(*parts), 1, AUDIT_DIGEST))


def scoped_id(prefix: str, *parts: Column) -> Column:
    """Package, domain reference, correlation and route ids: the prefix is hashed first."""
    digest = terminated_digest(F.lit(prefix), *parts)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, AUDIT_DIGEST))
