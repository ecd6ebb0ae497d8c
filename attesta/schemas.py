"""Table schemas, keys and physical partitioning of the evidence tables."""

from __future__ import annotations

from pyspark.sql import types as T

_SCOPE = "namespace_id string, domain_id string, system_id string, component_id string, environment string, evidence_type string, acl_scope string"
_META = "metadata map<string,string>"
_TAIL = "_seq timestamp, batch string"
_REF = "struct<reference_id:string,source_id:string,source_version_id:string,source_type:string,locator:string,role:string,provenance_ref:string,excerpt_hash:string,statement:string>"

_DDL = {
    "sources": f"source_id string, source_uri string, source_kind string, channel string, {_SCOPE}, mime_type string, size_bytes long, content_hash string, source_type string, {_META}, created_at timestamp, updated_at timestamp",
    "source_versions": f"source_version_id string, source_id string, source_uri string, version_number long, content_hash string, artifact_hash string, ingest_ts timestamp, parser_version string, object_key string, {_META}",
    "artifacts": f"artifact_hash string, source_version_id string, object_key string, mime_type string, size_bytes long, parser_name string, parser_version string, {_META}",
    "chunks": f"chunk_id string, source_id string, source_version_id string, artifact_hash string, {_SCOPE}, source_type string, ordinal long, text string, locator string, source_uri string, chunk_hash string, parser_version string, page int, line_start int, line_end int, ingest_ts timestamp, {_META}",
    "embeddings": "chunk_id string, source_version_id string, embedding_space_id string, model string, dimensions int, vector array<float>, provider string, model_revision string, normalized boolean, purpose string",
    "embedding_spaces": "embedding_space_id string, provider string, model string, model_revision string, dimension int, normalized boolean, corpus_ready boolean, active boolean",
    "embedding_migrations": "migration_id string, source_space_id string, target_space_id string, status string, processed long, total long",
    "namespaces": f"{_SCOPE}, asset_name string, component_name string, sanitized_summary string, {_META}",
    "integration_edges": f"edge_id string, source_namespace_id string, target_namespace_id string, relation_type string, domain_id string, system_id string, component_id string, environment string, evidence_type string, acl_scope string, {_META}",
    "code_symbols": f"symbol_id string, source_id string, source_version_id string, chunk_id string, name string, qualified_name string, kind string, signature string, locator string, line_start int, line_end int, language string, {_SCOPE}",
    "code_relationships": f"relationship_id string, symbol_id string, target string, relation_type string, source_id string, source_version_id string, chunk_id string, locator string, resolved boolean, language string, {_SCOPE}",
    "objects": "content_hash string, content binary, size_bytes long, mime_type string, seq long",
    "retrieval_events": "event_id string, query_hash string, filters string, selected_chunks array<string>, scores map<string,double>, reranker string, model_route string, created_at timestamp",
    "findings": f"finding_id string, classification string, statement string, confidence double, evidence_refs array<{_REF}>, time_start timestamp, time_end timestamp, systems array<string>, components array<string>, verification_status string, recommended_query string, supporting_evidence array<string>, contradicting_evidence array<string>, provenance_refs array<string>, correlation_ids array<string>, source_type_analyzers array<string>",
    "timeline": "event_id string, timestamp timestamp, statement string, source_id string, source_type string, locator string, correlation_ids array<string>, systems array<string>, provenance_ref string",
    "audit_reports": "report_id string, request_hash string, request_payload string, executive_summary string, human_report string, machine_report string, finding_ids array<string>, timeline_event_ids array<string>",
    "verification_requests": "request_id string, audit_id string, finding_id string, broker_name string, request_payload string, status string",
    "admin_operations": "operation_id string, operation string, status string, requested_at timestamp, actor string, target_id string, details map<string,string>",
    "entities": f"entity_id string, entity_type string, name string, {_META}",
    "tags": "tag_id string, name string",
    "entity_tags": "entity_id string, tag_id string",
    "jobs": "job_id string, source_id string, source_uri string, channel string, mime_type string, content_hash string, source_type string, source_kind string, parent_uri string, part string, error string",
    "lifecycle": "job_id string, state string, at timestamp, attempt int, details map<string,string>",
    "channel_events": "channel string, event_id string, message_id string, conversation_id string, thread_id string, reply_target string, actor_id string, auth_scope string, created_at timestamp",
    "diagnostic_jobs": "job_id string, payload_hash string, signature string, status string, attempt_count int, created_at timestamp, expires_at timestamp, leased_by string, lease_token string, lease_expires_at timestamp",
    "schema_migrations": "version string, checksum string, applied_at timestamp",
    "heartbeats": "worker_id string, status string, observed_at timestamp, metadata map<string,string>",
}

TABLES: list[str] = list(_DDL)


def table_schema(name: str) -> T.StructType:
    """Schema of one table; parsing DDL needs a running session."""
    return T.StructType.fromDDL(f"{_DDL[name]}, {_TAIL}")


KEYS: dict[str, list[str]] = {
    "sources": ["source_id"], "source_versions": ["source_version_id"], "artifacts": ["artifact_hash", "source_version_id"], "chunks": ["chunk_id"],
    "embeddings": ["chunk_id", "embedding_space_id"], "embedding_spaces": ["embedding_space_id"], "embedding_migrations": ["migration_id"],
    "namespaces": ["namespace_id"], "integration_edges": ["edge_id"], "code_symbols": ["symbol_id"], "code_relationships": ["relationship_id"],
    "objects": ["content_hash"], "retrieval_events": ["event_id"], "findings": ["finding_id"], "timeline": ["event_id"], "audit_reports": ["report_id"],
    "verification_requests": ["request_id"], "admin_operations": ["operation_id"], "entities": ["entity_id"], "tags": ["tag_id"],
    "entity_tags": ["entity_id", "tag_id"], "jobs": ["job_id"], "lifecycle": ["job_id", "at", "state"], "channel_events": ["channel", "event_id"],
    "diagnostic_jobs": ["job_id"], "heartbeats": ["worker_id"], "schema_migrations": ["version"],
}

# Written together with the version that owns them, before its marker.
VERSION_OWNED = {"artifacts", "chunks", "code_symbols", "code_relationships"}

# Content-addressed tables: a key is written once, so reading them needs no latest-wins pass.
IMMUTABLE = {"source_versions", "artifacts", "chunks", "code_symbols", "code_relationships", "objects", "retrieval_events", "lifecycle", "timeline"}

# Keys that searches look up by value; bloom filters let such reads skip row groups.
LOOKUP_COLUMNS: dict[str, list[str]] = {"chunks": ["chunk_id", "source_version_id"], "embeddings": ["chunk_id"], "objects": ["content_hash"], "source_versions": ["source_id"]}

# Partition columns that searches always restrict on, so files outside the scope are never opened.
PARTITIONS: dict[str, list[str]] = {"chunks": ["domain_id"], "embeddings": ["embedding_space_id"]}
