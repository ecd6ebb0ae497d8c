"""Administration of sources, indexes and embedding spaces, with an operation log."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.filters import RetrievalFilters
from attesta.operators.store import EvidenceStore, pending_embeddings
from attesta.plans.ingest import embedding_rows

# Operations and privacy policies.
OPERATIONS = ["retire", "retry_ingestion", "reparse", "reindex", "reembed"]
LEGAL_HOLD = "legal_hold"


def under_legal_hold(metadata: str = "metadata", key: str = LEGAL_HOLD) -> Column:
    return F.coalesce(F.try_element_at(F.col(metadata), F.lit(key)) == "true", F.lit(False))


@dataclass
class Administration:
    """Every operation is logged as running before it acts and again with its outcome."""

    store: EvidenceStore
    actor: str = "system"

    def _log(self, operation: str, target: str, action: Callable[[], dict[str, str]]) -> dict[str, str]:
        base = {"operation_id": f"admin_{uuid.uuid4().hex}", "operation": operation, "actor": self.actor, "target_id": target, "requested_at": datetime.now(timezone.utc)}
        self._record({**base, "status": "running"}, {}, "start")
        try:
            details = action()
            status = details.pop("status", "complete")
        except Exception as error:  # noqa: BLE001 - the outcome of a failed operation is data
            status, details = "failed", {"error": str(error)[:500]}
        self._record({**base, "status": status}, details, "finish")
        return {"operation_id": base["operation_id"], "status": status, **details}

    def _record(self, row: dict, details: dict[str, str], phase: str) -> None:
        schema = "operation_id string, operation string, status string, requested_at timestamp, actor string, target_id string, details map<string,string>"
        values = [(row["operation_id"], row["operation"], row["status"], row["requested_at"], row["actor"], row["target_id"], {k: str(v) for k, v in details.items()})]
        self.store.append("admin_operations", self.store.spark.createDataFrame(values, schema), f"{row['operation_id']}-{phase}")

    def retire(self, source_id: str, reason: str, allow: bool = True) -> dict[str, str]:
        """Mark a source retired; its evidence and provenance stay."""
        if not allow:
            raise PermissionError("retirement is disabled by policy")
        if not reason.strip():
            raise ValueError("a reason is required")
        source = self.store.current("sources").where(F.col("source_id") == source_id)
        found = source.select(under_legal_hold().alias("held")).first()
        if found is None:
            raise KeyError(f"unknown source: {source_id}")
        if found.held:
            raise PermissionError("source is under legal hold")

        def act() -> dict[str, str]:
            marks = F.create_map(*[F.lit(x) for kv in {"status": "retired", "retired_by": self.actor, "retirement_reason": reason}.items() for x in kv])
            changed = source.withColumns({"metadata": F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), marks), "updated_at": F.current_timestamp(), "_seq": F.current_timestamp()})
            self.store.append("sources", changed.drop("batch"), f"retire-{uuid.uuid4().hex}")
            return {"reason": reason}

        return self._log("retire", source_id, act)

    def reparse(self, source_id: str, parse: Callable[[DataFrame], DataFrame], ingest: Callable[[DataFrame], DataFrame]) -> dict[str, str]:
        """Run a new parser over the stored bytes of the latest version of a source."""

        def act() -> dict[str, str]:
            latest = self.store.provenance(RetrievalFilters(source_ids=(source_id,))).select("source_id", "source_version_id", "source_uri", "content_hash").distinct()
            stored = latest.join(self.store.read("objects").select("content_hash", "content"), "content_hash")
            versions = ingest(parse(stored))
            return {"versions": str(versions.count())}

        return self._log("reparse", source_id, act)

    def reindex(self, source_id: str, action: Callable[[str], object]) -> dict[str, str]:
        return self._log("reindex", source_id, lambda: {"result": str(action(source_id))})

    def reembed(self, space: str, provider: str = "LOCAL", privacy: str = "cloud_allowed", limit: int | None = None) -> dict[str, str]:
        """Embed what the target space lacks; stopping early leaves the rest pending."""

        def act() -> dict[str, str]:
            guard_privacy(provider, privacy)
            chunks = self.store.current("chunks").select("chunk_id", "source_version_id", "text")
            total = chunks.count()
            todo = pending_embeddings(chunks, self.store.read("embeddings"), space)
            todo = todo if limit is None else todo.limit(limit)
            self.store.append("embeddings", embedding_rows(todo, space), f"reembed-{uuid.uuid4().hex}")
            done = self.store.read("embeddings").where(F.col("embedding_space_id") == space).select("chunk_id").distinct().count()
            return {"status": "complete" if done >= total else "paused", "processed": str(done), "total": str(total)}

        return self._log("reembed", space, act)


class SpaceRegistry:
    """Registered embedding spaces and the active one."""

    def __init__(self, active: str) -> None:
        self.spaces = {active: "LOCAL"}
        self.active = active

    def register(self, space: str, provider: str = "LOCAL") -> None:
        self.spaces[space] = provider

    def switch(self, space: str, corpus_ready: bool = False) -> None:
        if space not in self.spaces:
            raise KeyError(f"embedding space is not registered: {space}")
        if not corpus_ready:
            raise ValueError("the active space switches only after its corpus is validated")
        self.active = space


def guard_privacy(provider: str, privacy: str) -> None:
    """Local-only evidence never reaches a remote provider."""
    if privacy == "local_only" and provider != "LOCAL":
        raise PermissionError("local_only evidence cannot use a remote embedding space")
