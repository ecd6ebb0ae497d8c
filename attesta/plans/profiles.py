"""Domain profiles, system aliases and boundary rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from attesta.operators.filters import RetrievalFilters, distinct
from attesta.plans.search_tools import SearchRequest
from attesta.sources.corpus import DOMAINS

# Aliases that name a domain, and the needles that imply one, in order.
DOMAIN_ALIASES = {
    "administrative": "contencioso_administrativo", "criminal": "criminal", "contraordenacional": "contraordenacional", "judicial": "contencioso_judicial",
    "sco": "contraordenacional", "sigef": "encargos_sigef", "sigepra": "contencioso_administrativo", "sicjut": "contencioso_judicial",
    "sinquer": "criminal", "encargos": "encargos_sigef",
}
DOMAIN_NEEDLES = [
    ("sinquer", "criminal"), ("criminal", "criminal"), ("sco", "contraordenacional"), ("contraordenacional", "contraordenacional"), ("sigef", "encargos_sigef"),
    ("sigepra", "contencioso_administrativo"), ("administrative", "contencioso_administrativo"), ("judicial", "contencioso_judicial"), ("sicjut", "contencioso_judicial"), ("encargos", "encargos_sigef"),
]
DOMAIN_NAMES = {
    "criminal": "Criminal", "contraordenacional": "Contraordenacional", "contencioso_administrativo": "Contencioso Administrativo",
    "contencioso_judicial": "Contencioso Judicial", "encargos_sigef": "Encargos SIGEF",
}
ADMINISTRATIVE_SYSTEMS = ("SICAT", "SICATPF", "SIGEPRA", "WSCAT", "ISIGEPRAWS", "JTRECLBAT")
SIGEF_ALIASES = {
    "sigef": ("sigef", "SIGEF"), "sigefbat": ("sigefbat", "SIGEFBAT"), "ef": ("ef", "EF", "ef_batch", "EF_BATCH"),
    "encargos": ("encargos", "ENCARGOS", "encargos_batch", "ENCARGOS_BATCH"),
}
READ_OPERATIONS = ("read_select", "describe")


@dataclass(frozen=True)
class DomainProfile:
    """Policy of one domain; ``retrieval_system_ids`` is a hard system limit when set."""

    domain_id: str
    retrieval_system_ids: Sequence[str] = ()
    system_aliases: Sequence[str] = ()
    aliases: Sequence[str] = ()
    owned_systems: Sequence[str] = ()
    delegated_domains: Sequence[str] = ()
    defaults: RetrievalFilters = field(default_factory=RetrievalFilters)


PROFILES = {
    **{d: DomainProfile(d) for d in DOMAINS},
    "contencioso_administrativo": DomainProfile(
        "contencioso_administrativo", ADMINISTRATIVE_SYSTEMS, tuple(s.lower() for s in ADMINISTRATIVE_SYSTEMS), ("administrative",), ADMINISTRATIVE_SYSTEMS,
        ("contencioso_judicial", "encargos_sigef"),
    ),
    "contencioso_judicial": DomainProfile(
        "contencioso_judicial", aliases=("judicial",), owned_systems=("SICJUT", "SICJUTPF", "SICJUTINDBAT"), delegated_domains=("contencioso_administrativo", "encargos_sigef"),
        defaults=RetrievalFilters(principal_acl_scopes=("internal",)),
    ),
    "contraordenacional": DomainProfile("contraordenacional", aliases=("sco",), owned_systems=("sco_application", "sco_batches", "sco_process_management"), defaults=RetrievalFilters(principal_acl_scopes=("internal",))),
    "criminal": DomainProfile("criminal", owned_systems=("criminal_casework", "criminal_evidence", "sinquer", "sinquer_criminal")),
    "encargos_sigef": DomainProfile("encargos_sigef", owned_systems=tuple(a for aliases in SIGEF_ALIASES.values() for a in aliases)),
}


def scoped_filters(profile: DomainProfile, requested: RetrievalFilters, allow_delegation: bool = False) -> RetrievalFilters:
    """Filters of a request inside a profile: requests narrow the domain's scope, never widen it."""
    if requested.principal_domain_id and requested.principal_domain_id.strip() != profile.domain_id:
        raise PermissionError("a request cannot change the principal domain")
    foreign = [d for d in (*requested.domain_ids, *requested.domains) if d != profile.domain_id]
    if (foreign or requested.delegated_domain_ids) and not allow_delegation:
        raise PermissionError("cross-domain retrieval needs delegation")
    wider = set(requested.principal_acl_scopes) - set(profile.defaults.principal_acl_scopes)
    if wider:
        raise PermissionError(f"access scopes cannot be widened: {sorted(wider)}")
    systems = tuple(requested.system_ids)
    if profile.retrieval_system_ids:
        names = dict(zip((a.lower() for a in profile.system_aliases), profile.retrieval_system_ids))
        systems = tuple(names.get(s.lower(), s) for s in systems) or tuple(profile.retrieval_system_ids)
        outside = set(systems) - set(profile.retrieval_system_ids)
        if outside:
            raise PermissionError(f"systems outside the domain: {sorted(outside)}")
    return replace(
        requested,
        principal_acl_scopes=tuple(profile.defaults.principal_acl_scopes),
        principal_domain_id=profile.domain_id,
        domain_ids=(profile.domain_id,),
        domains=(profile.domain_id,),
        delegated_domain_ids=tuple(requested.delegated_domain_ids) if allow_delegation else (),
        system_ids=systems,
    ).normalized()


def delegated_request(profile: DomainProfile, request: SearchRequest, targets: Sequence[str], aliases: Mapping[str, str] = DOMAIN_ALIASES) -> SearchRequest:
    """The request widened to delegated domains the profile may reach."""
    resolved = tuple(aliases.get(t.lower(), t) for t in targets)
    if not resolved:
        raise PermissionError("delegated domains are required")
    if not set(resolved) <= set(profile.delegated_domains):
        raise PermissionError("delegation target is not registered for this domain")
    widened = replace(request.filters, delegated_domain_ids=resolved)
    return replace(request, filters=scoped_filters(profile, widened, allow_delegation=True))


def collaboration_request(profile: DomainProfile, target: str, query: str, evidence_refs: Sequence[str]) -> dict[str, object]:
    """A hand-off to another domain that leaves this domain's scope as it is."""
    if target not in profile.delegated_domains:
        raise PermissionError("collaboration target is not approved for this domain")
    if not evidence_refs:
        raise ValueError("evidence references are required")
    return {"status": "cross_domain_required", "source_domain_id": profile.domain_id, "target_domain_id": target, "query": query.strip(), "evidence_refs": list(evidence_refs)}


def diagnostic_request(profile: DomainProfile, operation: str, payload: Mapping[str, object]) -> dict[str, object]:
    if operation not in READ_OPERATIONS:
        raise PermissionError("diagnostic operation is not read-only")
    return {**payload, "domain_id": profile.domain_id, "operation_class": operation, "status": "pending"}


def expand_systems(values: Sequence[str], aliases: Mapping[str, Sequence[str]] = SIGEF_ALIASES) -> tuple[str, ...]:
    """All system ids behind the given aliases; unknown names are refused."""
    unknown = [v for v in values if v.strip() and v.strip().lower() not in aliases]
    if unknown:
        raise PermissionError(f"systems outside the domain boundary: {unknown}")
    return distinct(system for v in values if v.strip() for system in aliases[v.strip().lower()])


def batch_query(batch_id: str, predecessor: str = "", successor: str = "") -> str:
    if not batch_id.strip():
        raise ValueError("batch_id is required")
    return " ".join(p.strip() for p in (batch_id, predecessor, successor) if p and p.strip())


def resolve_domain(value: str, profiles: Mapping[str, DomainProfile] = PROFILES) -> str:
    """Domain of an id, alias or owned system; case-insensitive, ``_`` and ``-`` alike."""
    fold = lambda x: x.strip().lower().replace("_", "-")
    name = fold(value)
    if name in DOMAIN_ALIASES:
        return DOMAIN_ALIASES[name]
    for domain, profile in profiles.items():
        if name in {fold(x) for x in (domain, *profile.aliases, *profile.system_aliases, *profile.owned_systems)}:
            return domain
    raise KeyError(f"unknown domain or system alias: {value}")


def infer_domains(text: str, whole_words: bool = False) -> tuple[str, ...]:
    """Domains named in a text, in needle order; ``whole_words`` stops hits inside longer words."""
    lowered = text.lower()
    present = (lambda n: re.search(rf"\b{n}\b", lowered)) if whole_words else (lambda n: n in lowered)
    return distinct(d for n, d in DOMAIN_NEEDLES if present(n))
