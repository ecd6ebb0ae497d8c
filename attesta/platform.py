"""One object over the evidence store: ingest, search, symbols, audit, backup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.vectors import EMBEDDING_DIMENSION, space_id
from attesta.operators import code_index
from attesta.operators.filters import RetrievalFilters, compile_filters
from attesta.operators.store import EvidenceStore
from attesta.plans import audit, retrieval, search_tools
from attesta.plans.admin import SpaceRegistry, guard_privacy
from attesta.plans.ingest import ingest
from attesta.streaming.ingest import process_batch
from attesta.sources.files import scan_files


@dataclass
class Platform:
    """Evidence platform below one folder of shared storage."""

    spark: SparkSession
    root: str
    dimension: int = EMBEDDING_DIMENSION
    spaces: SpaceRegistry = field(init=False)

    def __post_init__(self) -> None:
        self.store = EvidenceStore(self.spark, self.root)
        self.spaces = SpaceRegistry(space_id(f"hash-{self.dimension}", self.dimension))

    def ingest(self, raw: DataFrame, batch: str) -> DataFrame:
        return ingest(self.store, raw, batch, self.spaces.active)

    def ingest_files(self, path: str, batch: str, channel: str = "directory", **scope: str) -> DataFrame:
        return process_batch(self.store, scan_files(self.spark, path), channel, batch, self.spaces.active, **scope)

    def search(self, query: str, filters: RetrievalFilters | None = None, privacy: str = "cloud_allowed", record: str | None = None) -> DataFrame:
        """Hybrid search; ``record`` names the batch under which the retrieval event is kept."""
        f = filters or RetrievalFilters()
        guard_privacy(self.spaces.spaces[self.spaces.active], privacy)
        hits = retrieval.search(self.store.current("chunks"), self.store.current("embeddings"), query, f, active_space=self.spaces.active)
        if record:
            self.store.append("retrieval_events", retrieval.retrieval_event(query, f, hits), record)
        return hits

    def search_code_symbols(self, query: str, filters: RetrievalFilters | None = None) -> DataFrame:
        f = filters or RetrievalFilters()
        return code_index.search_symbols(self.store.current("code_symbols").where(compile_filters(f)), query, f.limit)

    def tool(self, mode: str, request: search_tools.SearchRequest) -> DataFrame:
        return search_tools.search_packages(self.store.current("chunks"), mode, request)

    def tools(self) -> dict[str, Callable[[search_tools.SearchRequest], DataFrame]]:
        """The search tools by name, for an agent runtime."""
        return {f"search_{mode}": partial(self.tool, mode) for mode in search_tools.TOOL_SOURCE_TYPES}

    def audit(self, request: audit.AuditRequest | str, batch: str | None = None) -> DataFrame:
        """Report row of a failure audit; with ``batch`` findings, timeline and report are stored."""
        asked = audit.AuditRequest.parse(request) if isinstance(request, str) else request
        hits = audit.materialized_hits(self.store.current("chunks"), asked)
        report = audit.report(hits, asked)
        if batch:
            found = audit.findings(hits, asked)
            named = {"supporting": "supporting_evidence", "provenance": "provenance_refs"}
            self.store.append("findings", found.withColumnsRenamed(named).withColumn("source_type_analyzers", F.array("analyzer")), batch)
            self.store.append("timeline", audit.timeline(hits), batch)
            self.store.append("audit_reports", report.withColumn("request_payload", F.lit(asked.query)), batch)
            self.store.append("verification_requests", audit.verification_requests(found, asked), batch)
        return report

    def backup(self, target: str) -> None:
        self.store.snapshot(target)

    def add_evidence(self, source_id: str, text: str, locator: str, batch: str) -> DataFrame:
        """Add one ad-hoc note to the general domain."""
        rows = [(source_id, locator, text, "ad_hoc", "evidence")]
        return self.ingest(self.spark.createDataFrame(rows, "source_id string, source_uri string, content string, source_kind string, source_type string"), batch)

    def find_evidence(self, query: str) -> DataFrame:
        return self.search(query, RetrievalFilters(principal_acl_scopes=("internal",)))
