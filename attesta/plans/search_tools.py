"""Domain-scoped search tools: exact, symbol, log and semantic search over chunks.

Every tool takes chunks that already passed the scope predicate, scores them with JVM
expressions, keeps the top-k and packages it by source version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import extract
from attesta.functions import text as T
from attesta.operators import packaging, ranking
from attesta.operators.filters import RetrievalFilters, compile_filters
from attesta.plans.retrieval import hybrid_best

# Evidence classes searched by each tool, and score floors.
TOOL_SOURCE_TYPES = {
    "code_exact": ("code",), "code_symbols": ("code",), "code_semantic": ("code",), "logs": ("log",), "docs": ("document",),
    "schema": ("schema",), "query_outputs": ("query-output",), "domain_evidence": ("document", "log", "code", "schema", "query-output"),
}
EXACT_FLOOR = 0.5
SYMBOL_FLOOR = 0.75
ID_BOOST = 0.5
TIME_BOOST = 0.25
BROWSE_SCORE = 0.25


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    path: str | None = None
    module: str | None = None
    class_name: str | None = None
    method_name: str | None = None
    correlation_ids: Sequence[str] = ()
    request_ids: Sequence[str] = ()
    session_ids: Sequence[str] = ()
    since: datetime | None = None
    until: datetime | None = None
    limit: int = 10
    filters: RetrievalFilters = field(default_factory=RetrievalFilters)


def _metadata(chunks: DataFrame, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("metadata"), F.lit(key)), F.lit("")) if "metadata" in chunks.columns else F.lit("")


def _symbols() -> Column:
    return extract.symbol_names(F.col("text"), F.col("source_uri"))


def _haystack(chunks: DataFrame, symbols: Column) -> Column:
    meta = [_metadata(chunks, k) for k in ("module_name", "class_name", "method_name")]
    return F.lower(F.concat_ws(" ", F.col("text"), F.col("locator"), F.col("source_uri"), *meta, F.array_join(symbols, " ")))


def matching(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """Chunks that hold every query term and satisfy the path, module, class and method limits.

    Adds ``symbols`` (lower-cased) for the scorers.
    """
    lowered = F.transform(_symbols(), F.lower)
    named = chunks.withColumn("symbols", lowered)
    hay = _haystack(chunks, F.col("symbols"))
    predicate = T.contains_all(hay, T.split_terms(request.query))
    if request.path:
        wanted = F.lit("/".join(p for p in request.path.lower().split("/") if p not in ("", ".")) if not request.path.startswith("/") else request.path.lower())
        predicate = predicate & (F.contains(F.lower("source_uri"), wanted) | F.contains(F.lower("locator"), wanted))
    if request.module:
        predicate = predicate & F.array_contains(F.array(F.lower(extract.file_stem(F.col("source_uri"))), F.lower(_metadata(chunks, "module_name"))), request.module.lower())
    for name in (request.class_name, request.method_name):
        if name:
            predicate = predicate & (F.array_contains("symbols", name.lower()) | F.contains(hay, F.lit(name.lower())))
    return named.where(predicate)


def exact_hits(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """1.0 when the whole query occurs, else the share of its terms, at least ``EXACT_FLOOR``."""
    query = request.query.strip()
    found = matching(chunks, replace(request, query=query))
    hay = F.lower(F.concat_ws(" ", F.col("text"), F.col("locator"), F.col("source_uri"), F.array_join("symbols", " ")))
    scored = found.withColumn("lexical_score", T.term_score(hay, T.split_terms(query)))
    if query:
        scored = scored.where(F.col("lexical_score") > 0)
    partial = F.greatest(F.lit(EXACT_FLOOR), F.col("lexical_score"))
    score = F.when(F.contains(hay, F.lit(query.lower())), F.lit(1.0)).otherwise(partial) if query else partial
    return scored.withColumns({"score": score, "semantic_score": F.lit(0.0)})


def symbol_hits(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """1.0 when the query names a symbol, else the share of terms, at least ``SYMBOL_FLOOR``."""
    query = request.query.strip()
    found = matching(chunks, replace(request, query=query))
    hay = F.lower(F.concat_ws(" ", F.col("locator"), F.col("source_uri"), F.array_join("symbols", " ")))
    scored = found.withColumn("lexical_score", T.term_score(hay, T.split_terms(query)))
    floor = F.greatest(F.col("lexical_score"), F.lit(SYMBOL_FLOOR))
    score = F.when(F.array_contains("symbols", query.lower()), F.lit(1.0)).otherwise(floor) if query else floor
    return scored.withColumns({"score": score, "semantic_score": F.lit(0.0)})


def log_hits(logs: DataFrame, request: SearchRequest) -> DataFrame:
    """Log chunks by identifier and time.

    A chunk leaves the time range only when all of its timestamps are outside; chunks
    without timestamps stay. Identifiers match case-insensitively.
    """
    query, text = request.query.strip(), F.col("text")
    found = logs.where((F.col("evidence_type") == "log") | (F.col("source_type") == "log")).withColumn("timestamps", extract.timestamps(text))
    boost = F.lit(0.0)
    for kind, wanted in (("correlation", request.correlation_ids), ("request", request.request_ids), ("session", request.session_ids)):
        if wanted:
            own = F.transform(extract.typed_ids(text, kind), F.lower)
            found = found.where(F.arrays_overlap(own, F.array(*[F.lit(w.lower()) for w in wanted])))
            boost = boost + F.lit(ID_BOOST)
    if request.since is not None:
        since = F.lit(request.since).cast("timestamp")
        found = found.where((F.size("timestamps") == 0) | F.exists("timestamps", lambda t: t >= since))
    if request.until is not None:
        until = F.lit(request.until).cast("timestamp")
        found = found.where((F.size("timestamps") == 0) | F.exists("timestamps", lambda t: t <= until))
    if request.since is not None or request.until is not None:
        boost = boost + F.when(F.size("timestamps") > 0, F.lit(TIME_BOOST)).otherwise(F.lit(0.0))
    hay = F.lower(F.concat_ws(" ", text, F.col("locator"), F.col("source_uri")))
    scored = found.withColumns({"lexical_score": T.term_score(hay, T.split_terms(query)), "boost": boost})
    if query:
        scored = scored.where((F.col("lexical_score") > 0) | (F.col("boost") > 0))
    score = F.greatest("lexical_score", "boost")
    if not query:
        score = F.when(score == 0, F.lit(BROWSE_SCORE)).otherwise(score)
    return scored.withColumns({"score": score, "semantic_score": F.lit(0.0)}).drop("boost")


def lexical_hits(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """The lexical part of semantic search, for corpora without vectors."""
    scored = chunks.withColumn("lexical_score", T.lexical_score(F.col("text"), T.query_terms(request.query or " ")))
    return scored.withColumns({"semantic_score": F.lit(0.0), "score": ranking.hybrid_score(F.lit(0.0), F.col("lexical_score"))})


SCORERS = {"code_exact": exact_hits, "code_symbols": symbol_hits, "logs": log_hits}


def search(chunks: DataFrame, mode: str, request: SearchRequest, embeddings: DataFrame | None = None, query_vector: Sequence[float] = ()) -> DataFrame:
    """Ranked hits of one tool: scope first, then the tool's scorer, then top-k.

    ``embeddings`` (``chunk_id, vector`` of one space) and ``query_vector`` add the vector side to the
    semantic tools; exact, symbol and log search have none.
    """
    types = tuple(request.filters.source_types) or TOOL_SOURCE_TYPES[mode]
    evidence = tuple(request.filters.evidence_types) or types
    scope = replace(request.filters, source_types=types, evidence_types=evidence, since=None, until=None) if mode == "logs" else replace(request.filters, source_types=types, evidence_types=evidence)
    allowed = chunks.where(compile_filters(scope))
    if embeddings is not None and mode not in SCORERS:
        return hybrid_best(allowed, request.query, request.limit, embeddings=embeddings, query_vector=query_vector)
    return ranking.top_k(SCORERS.get(mode, lexical_hits)(allowed, request), request.limit)


def search_packages(chunks: DataFrame, mode: str, request: SearchRequest, embeddings: DataFrame | None = None, query_vector: Sequence[float] = ()) -> DataFrame:
    return packaging.package_hits(search(chunks, mode, request, embeddings, query_vector), request.query, mode)


def retrieve(chunks: DataFrame, request: SearchRequest, mode: str | None = None) -> DataFrame:
    """Identifier-like queries take the exact path, everything else the evidence path."""
    import re

    exact = mode in ("exact", "symbol") or re.fullmatch(extract.IDENTIFIER_QUERY, request.query.strip())
    return search_packages(chunks, "code_exact" if exact else "domain_evidence", request)


def enrich(hits: DataFrame) -> DataFrame:
    """Symbols, identifiers, timestamps and size estimates of each hit."""
    text = F.col("text")
    ids_of = {f"{k}_ids": extract.typed_ids(text, k) for k in ("correlation", "request", "session")}
    return hits.withColumns(
        {"symbol_names": _symbols(), "timestamps": extract.timestamps(text), "estimated_tokens": T.estimated_tokens(text), "estimated_bytes": T.estimated_bytes(text), **ids_of}
    )


def handoffs(packages: DataFrame, edges: DataFrame, domain_id: str) -> DataFrame:
    """Packages whose namespace has an edge into another domain: those need delegation.

    ``edges`` has ``source_namespace_id, target_domain_id, edge_id``.
    """
    foreign = edges.where((F.col("target_domain_id") != "") & (F.col("target_domain_id") != domain_id))
    return packages.join(foreign, packages["namespace_id"] == foreign["source_namespace_id"])


def package_findings(packages: DataFrame, label: str) -> DataFrame:
    """One fact per evidence reference of the packages."""
    refs = packages.select("package_id", F.inline("evidence_refs"))
    return refs.select(
        F.lit("fact").alias("classification"), F.concat(F.lit(f"{label} evidence matched: "), F.col("statement")).alias("statement"), F.lit(1.0).alias("confidence"), "provenance_ref", "reference_id"
    )
