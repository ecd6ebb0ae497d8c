"""Retrieval scope as a value object and its compilation to one predicate Column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct(values: Iterable[str]) -> tuple[str, ...]:
    """Non-empty values, first occurrence kept."""
    return tuple(dict.fromkeys(v for v in values if v))


@dataclass(frozen=True)
class RetrievalFilters:
    """Empty collections mean "no restriction"; ``strict_acl`` turns that off for ACL scopes."""

    principal_acl_scopes: Sequence[str] = ()
    principal_domain_id: str | None = None
    domain_ids: Sequence[str] = ()
    delegated_domain_ids: Sequence[str] = ()
    system_ids: Sequence[str] = ()
    component_ids: Sequence[str] = ()
    evidence_types: Sequence[str] = ()
    namespace_ids: Sequence[str] = ()
    domains: Sequence[str] = ()
    systems: Sequence[str] = ()
    environments: Sequence[str] = ()
    source_types: Sequence[str] = ()
    source_ids: Sequence[str] = ()
    embedding_space_id: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    limit: int = 10
    neighbor_window: int = 1
    strict_acl: bool = False

    def normalized(self) -> RetrievalFilters:
        lists = {f.name: tuple(v for v in getattr(self, f.name) if v) for f in fields(self) if isinstance(f.default, tuple)}
        principal = (self.principal_domain_id or "").strip() or None
        return replace(
            self,
            **lists,
            principal_domain_id=principal,
            embedding_space_id=self.embedding_space_id or None,
            limit=max(1, int(self.limit)),
            neighbor_window=max(0, int(self.neighbor_window)),
        )

    @property
    def effective_domains(self) -> tuple[str, ...]:
        """A principal sees its own and delegated domains only, whatever else was asked for."""
        principal = (self.principal_domain_id or "").strip()
        if principal:
            return distinct((principal, *self.delegated_domain_ids))
        return distinct(self.domain_ids) or distinct(self.domains)

    @property
    def effective_systems(self) -> tuple[str, ...]:
        return distinct(self.system_ids) or distinct(self.systems)


def compile_filters(filters: RetrievalFilters, time_column: str = "ingest_ts", columns: Iterable[str] | None = None) -> Column:
    """One deterministic predicate over the chunk columns.

    Only column comparisons with literals are used, so the whole predicate reaches the scan.
    Restrictions on columns missing from ``columns`` are an error, never silently dropped.
    """
    f = filters.normalized()
    members = {
        "acl_scope": tuple(f.principal_acl_scopes),
        "namespace_id": distinct(f.namespace_ids),
        "domain_id": f.effective_domains,
        "system_id": f.effective_systems,
        "component_id": distinct(f.component_ids),
        "evidence_type": distinct(f.evidence_types),
        "environment": distinct(f.environments),
        "source_type": distinct(f.source_types),
        "source_id": distinct(f.source_ids),
    }
    available = set(columns) if columns is not None else None
    predicate = F.lit(True)
    if f.strict_acl and not members["acl_scope"]:
        return F.lit(False)
    for column, allowed in members.items():
        if allowed:
            if available is not None and column not in available:
                raise ValueError(f"cannot restrict on missing column {column}")
            predicate = predicate & F.col(column).isin(list(allowed))
    if f.since is not None:
        predicate = predicate & (F.col(time_column) >= F.lit(f.since))
    if f.until is not None:
        predicate = predicate & (F.col(time_column) <= F.lit(f.until))
    return predicate


def admin_visible(filters: RetrievalFilters, include_retired: bool = False) -> Column:
    """Source visibility for administration: scope plus retirement, no time or type limits."""
    scope = compile_filters(replace(filters, since=None, until=None, source_types=()))
    return scope if include_retired else scope & (source_status() != "retired")


def source_status(metadata: str = "metadata") -> Column:
    return F.coalesce(F.try_element_at(F.col(metadata), F.lit("status")), F.lit("active"))


def scopes_within(scopes: Column, allowed: Sequence[str]) -> Column:
    """True when every scope of the array is allowed."""
    return F.size(F.array_except(scopes, F.array(*[F.lit(a) for a in allowed]))) == 0


def allow_list(
    actor_ids: Sequence[str] = (),
    conversation_ids: Sequence[str] = (),
    reply_targets: Sequence[str] = (),
    auth_scopes: Sequence[str] = ("internal",),
) -> Column:
    """Channel allow-list over actor, conversation, reply target and authorisation scope."""
    predicate = F.lit(True)
    for column, allowed in (("actor_id", actor_ids), ("conversation_id", conversation_ids), ("auth_scope", auth_scopes)):
        if allowed:
            predicate = predicate & F.col(column).isin(list(allowed))
    if reply_targets:
        predicate = predicate & F.coalesce(F.col("reply_target"), F.col("message_id"), F.lit("")).isin(list(reply_targets))
    return predicate
