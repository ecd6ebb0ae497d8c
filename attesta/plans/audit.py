"""Failure audit: evidence hits to findings, timeline, causal chains and report.

The corpus is scanned once. ``row_number() <= 24`` per source type keeps 24 rows per type and
task before the shuffle; everything after that works on at most 24 hits per source type.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import extract, ids
from attesta.functions import text as T
from attesta.operators import joins, ranking
from attesta.operators.filters import RetrievalFilters, compile_filters
from attesta.plans.retrieval import hybrid_best
from attesta.session import cut_lineage

# Hits per source type, confidences, and statement wording.
HITS_PER_TYPE = 24
DOC_TERMS = ["verify", "verification", "on-prem", "controlled", "evidence"]
DOC_TYPES = ["document", "docs", "doc", "markdown"]
INTEGRATION_TYPES = ["wsdl", "soap", "rest", "integration"]
CLASSES = ["fact", "inference", "hypothesis", "missing_evidence", "recommendation"]
LIVE_QUERY = "Run a controlled on-prem verification against the live database and compare the result set against this query output."
RECOMMENDATION = "Request a controlled on-prem verification job to confirm the live database state before any conclusion is drawn from the query output."

FINDING = "classification string, statement string, confidence double, verification_status string, analyzer string, references array<string>, supporting array<string>, provenance array<string>, systems array<string>, correlation_ids array<string>, time_start timestamp, time_end timestamp"


@dataclass(frozen=True)
class AuditRequest:
    query: str
    scope: str = ""
    systems: Sequence[str] = ()
    components: Sequence[str] = ()
    symptoms: Sequence[str] = ()
    source_types: Sequence[str] = ()
    correlation_ids: Sequence[str] = ()
    since: datetime | None = None
    until: datetime | None = None
    live_verification: bool = False

    @property
    def search_terms(self) -> str:
        return " ".join(p for p in (self.query, self.scope, *self.systems, *self.components, *self.symptoms) if p).strip() or "failure audit"

    def filters(self) -> RetrievalFilters:
        return RetrievalFilters(
            principal_acl_scopes=("internal",), systems=tuple(self.systems), source_types=tuple(self.source_types), since=self.since, until=self.until, limit=HITS_PER_TYPE
        )

    @classmethod
    def parse(cls, text: str) -> AuditRequest:
        """Read scope, systems and the rest from ``name: value`` mentions in free text."""
        lowered = text.lower()

        def after(*names: str) -> str:
            for name in names:
                at = lowered.find(f"{name}:")
                if at >= 0:
                    rest = text[at + len(name) + 1 :].strip().splitlines()
                    return rest[0] if rest else ""
            return ""

        split = lambda v: tuple(T.split_terms(v, r"[,\n;]"))
        trimmed = lambda v: tuple(x.strip() for x in split(v))
        kinds = ("log", "code", "schema", "document", "query-output", "splunk-csv")
        return cls(
            query=text.strip(),
            scope=after("scope", "for", "about"),
            systems=trimmed(after("system", "systems")),
            components=trimmed(after("component", "components")),
            symptoms=trimmed(after("symptom", "symptoms", "failure", "error")),
            source_types=tuple(k for k in kinds if k in lowered or k.replace("-", " ") in lowered),
            correlation_ids=tuple(re.findall(extract.CORRELATION_ID, text)),
            live_verification=any(w in lowered for w in ("live verification", "on-prem", "database", "db")),
        )


def reference_id(role: str, tag: str) -> Column:
    return ids.audit_id("eref", F.col("source_id"), F.col("source_version_id"), F.col("locator"), F.lit(role), F.lit(tag))


def audit_hits(chunks: DataFrame, request: AuditRequest, per_type: int = HITS_PER_TYPE, embeddings: DataFrame | None = None, query_vector: Sequence[float] = ()) -> DataFrame:
    """Best hits of every source type, by lexical and, with ``embeddings``, vector score.

    Ids and scores are ranked; texts are fetched for the winners. All types in scope are ranked in one
    pass, so there is no list of discovered types that could miss one.
    """
    allowed = chunks.where(compile_filters(request.filters()))
    return hybrid_best(allowed, request.search_terms, per_type, ["source_type"], embeddings=embeddings, query_vector=query_vector)


def materialized_hits(chunks: DataFrame, request: AuditRequest, per_type: int = HITS_PER_TYPE, **side) -> DataFrame:
    """Hits computed once for all analyzers.

    At most ``per_type`` rows per source type remain, so they fit one partition, and the
    analyzers aggregate them without further exchanges.
    """
    return cut_lineage(audit_hits(chunks, request, per_type, **side)).coalesce(1)


def source_types(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_type").distinct()


def _set(value: Column) -> Column:
    return F.sort_array(F.collect_set(value))


def _finding(classification: str | Column, statement: Column, confidence: float, status: str | Column, analyzer: str, **arrays: Column) -> list[Column]:
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    empty = F.array().cast("array<string>")
    named = ["references", "supporting", "provenance", "systems", "correlation_ids"]
    none = F.lit(None).cast("timestamp")
    return [
        column(classification).alias("classification"), statement.alias("statement"), F.lit(confidence).alias("confidence"), column(status).alias("verification_status"), F.lit(analyzer).alias("analyzer"),
        *[arrays.get(n, empty).alias(n) for n in named], arrays.get("time_start", none).alias("time_start"), arrays.get("time_end", none).alias("time_end"),
    ]


def _of(hits: DataFrame, types: Sequence[str]) -> DataFrame:
    return hits.where(F.col("source_type").isin(list(types)))


def _per_hit(role: str, tag: str) -> dict[str, Column]:
    return {
        "references": F.array(reference_id(role, tag)), "supporting": F.array("chunk_id"), "provenance": F.array("locator"),
        "systems": F.when(F.col("system_id") != "", F.array("system_id")).otherwise(F.array().cast("array<string>")),
    }


def analyze_logs(hits: DataFrame, request: AuditRequest) -> DataFrame:
    """Failure signal and correlation identifiers over the log hits."""
    logs = _of(hits, ["log"]).withColumns(
        {
            "bad": extract.has_error(F.col("text")), "cids": extract.correlation_ids(F.col("text")), "ts": extract.timestamps(F.col("text")),
            "bad_ref": reference_id("log-observation", "observed"), "cid_ref": reference_id("correlation-observation", "observed"),
        }
    )
    correlated = F.size("cids") > 0
    only = lambda cond, c: _set(F.when(cond, F.col(c)))
    asked = F.array(*[F.lit(c) for c in request.correlation_ids]).cast("array<string>")
    facts = logs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), only(F.col("bad"), "locator").alias("bad_locators"), only(F.col("bad"), "chunk_id").alias("bad_chunks"),
        only(F.col("bad"), "bad_ref").alias("bad_refs"), only(correlated, "locator").alias("cid_locators"), only(correlated, "chunk_id").alias("cid_chunks"), only(correlated, "cid_ref").alias("cid_refs"),
        F.flatten(F.collect_list("cids")).alias("all_ids"), F.min(F.array_min("ts")).alias("t0"), F.max(F.array_max("ts")).alias("t1"), _set(F.when(F.col("system_id") != "", F.col("system_id"))).alias("sys"),
    ).withColumn("idlist", F.array_sort(F.array_distinct(F.concat("all_ids", asked))))
    shared = {"systems": F.col("sys"), "time_start": F.col("t0"), "time_end": F.col("t1"), "correlation_ids": F.col("idlist")}
    signal = F.concat(F.lit("Application logs contain a failure signal in "), F.array_join("bad_locators", ", "), F.lit("."))
    listed = F.concat(F.lit("Correlation identifiers were present in the logs: "), F.array_join("idlist", ", "), F.lit("."))
    failure = facts.where("n_bad > 0").select(*_finding("fact", signal, 0.98, "observed", "log", references=F.col("bad_refs"), supporting=F.col("bad_chunks"), provenance=F.col("bad_locators"), **shared))
    identifiers = facts.where((F.col("n") > 0) & (F.size("idlist") > 0)).select(
        *_finding("fact", listed, 0.95, "observed", "log", references=F.col("cid_refs"), supporting=F.col("cid_chunks"), provenance=F.col("cid_locators"), **shared)
    )
    return failure.unionByName(identifiers)


def analyze_exports(hits: DataFrame, request: AuditRequest) -> DataFrame:
    """Row count, columns, time range and identifiers of every log-search export."""
    lines = F.filter(T.splitlines(T.strip(F.col("text"))), lambda ln: T.strip(ln) != "")
    rows = _of(hits, ["splunk-csv"]).withColumn("lines", lines).withColumns(
        {"header": T.csv_cells(F.get("lines", F.lit(0))), "body": F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))}
    )
    cids = F.array_sort(F.array_distinct(F.flatten(F.transform("body", lambda ln: extract.correlation_ids(F.replace(ln, F.lit(","), F.lit(" ")))))))
    with_time = rows.withColumns({"cids": cids, "ts": extract.timestamps(F.array_join("body", " "))})
    base = F.concat(
        F.lit("Splunk export at "), F.col("locator"), F.lit(" contains "), F.size("body").cast("string"), F.lit(" event row(s) with columns "), F.array_join("header", ", "), F.lit("."),
        F.when(F.size("cids") > 0, F.concat(F.lit(" Correlation IDs observed: "), F.array_join("cids", ", "), F.lit("."))).otherwise(F.lit("")),
    )
    found = with_time.where(F.size("body") > 0)
    return found.select(
        *_finding("fact", base, 0.9, "observed", "splunk-csv", **_per_hit("splunk-export", "observed"), correlation_ids=F.col("cids"), time_start=F.array_min("ts"), time_end=F.array_max("ts"))
    )


def analyze_code(hits: DataFrame, request: AuditRequest) -> DataFrame:
    """Indexed symbols of code hits, and frames quoted inside code that name a code hit."""
    code = _of(hits, ["code"])
    matched = _frame_matches(code, code)
    quoted = matched.groupBy("chunk_id").agg(F.array_join(_set("raw"), ", ").alias("frames")).join(code, "chunk_id")
    text = F.concat(F.lit("Source code evidence matches the runtime stack frame(s) "), F.col("frames"), F.lit("."))
    frames = quoted.select(*_finding("fact", text, 0.96, "observed", "code", **_per_hit("code-match", "observed")))
    if "symbol_names" not in hits.columns:
        return frames
    first = F.slice("symbol_names", 1, 8)
    indexed = F.concat(F.lit("Persistent code index resolves symbols "), F.array_join(first, ", "), F.lit(" in "), F.col("locator"), F.lit("."))
    symbols = code.where(F.size("symbol_names") > 0).select(*_finding("fact", indexed, 0.9, "observed", "symbol-index", **_per_hit("code-symbol-index", "observed")))
    return symbols.unionByName(frames)


def _frame_matches(texts: DataFrame, code: DataFrame) -> DataFrame:
    frames = texts.select("chunk_id", F.inline(extract.stack_frames(F.col("text"))))
    return joins.frames_to_code(frames, code.select(F.col("chunk_id").alias("code_chunk"), "locator"))


def _listing(hits: DataFrame, types: Sequence[str], values: Column, label: str, confidence: float, analyzer: str, role: str) -> DataFrame:
    """One finding that lists the distinct values over all hits of some types."""
    found = _of(hits, types).withColumns({"values": values, "ref": reference_id(role, "observed")}).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"), _set("ref").alias("refs"), _set("chunk_id").alias("chunks"), _set("locator").alias("locators"),
        _set(F.when(F.col("system_id") != "", F.col("system_id"))).alias("sys"),
    )
    text = F.concat(F.lit(label), F.array_join("values", ", "), F.lit("."))
    return found.where(F.size("values") > 0).select(
        *_finding("fact", text, confidence, "observed", analyzer, references=F.col("refs"), supporting=F.col("chunks"), provenance=F.col("locators"), systems=F.col("sys"))
    )


def analyze_integrations(hits: DataFrame, request: AuditRequest) -> DataFrame:
    return _listing(hits, INTEGRATION_TYPES, extract.endpoints(F.col("text")), "Integration definitions expose endpoints or operations: ", 0.82, "integration", "integration-definition")


def analyze_schemas(hits: DataFrame, request: AuditRequest) -> DataFrame:
    objects = _listing(hits, ["schema"], extract.schema_objects(F.col("text")), "Schema evidence identifies objects: ", 0.92, "schema", "schema-object")
    about_queries = _of(hits, ["schema"]).withColumn("ref", reference_id("schema-query-consistency", "supporting")).agg(
        F.bool_or(F.contains(F.lower("text"), F.lit("query"))).alias("mentions"), _set("ref").alias("refs"), _set("chunk_id").alias("chunks"), _set("locator").alias("locators"), _set("system_id").alias("sys")
    )
    text = F.lit("Schema and query evidence are consistent with a data-access path rather than an isolated presentation-layer failure.")
    consistent = about_queries.where("mentions").select(
        *_finding("inference", text, 0.7, "inferred", "schema", references=F.col("refs"), supporting=F.col("chunks"), provenance=F.col("locators"), systems=F.col("sys"))
    )
    return objects.unionByName(consistent)


def analyze_query_outputs(hits: DataFrame, request: AuditRequest) -> DataFrame:
    """Result listings with rows are facts; empty ones are missing evidence."""
    rows = _of(hits, ["query-output"]).withColumn("n", F.size(extract.query_table_rows(F.col("text"))))
    gap = extract.has_zero_rows(F.col("text")) | (F.col("n") == 0)
    missing = F.concat(F.lit("Query output at "), F.col("locator"), F.lit(" does not provide sufficient live data to confirm the database state."))
    present = F.concat(F.lit("Query output at "), F.col("locator"), F.lit(" contains "), F.col("n").cast("string"), F.lit(" row(s) with explicit result evidence."))
    downstream = F.lit("The query output appears to capture a downstream failure signature rather than a successful operational state.")
    gaps = rows.where(gap).select(*_finding("missing_evidence", missing, 0.88, "needs_live_verification", "query-output", **_per_hit("query-output-gap", "supporting")))
    facts = rows.where(~gap).select(*_finding("fact", present, 0.9, "observed", "query-output", **_per_hit("query-output", "observed")))
    errors = rows.where(F.contains(F.lower("text"), F.lit("error"))).select(*_finding("hypothesis", downstream, 0.56, "unverified", "query-output", **_per_hit("query-output-hypothesis", "supporting")))
    return gaps.unionByName(facts).unionByName(errors)


def analyze_documents(hits: DataFrame, request: AuditRequest) -> DataFrame:
    mentions = F.rlike(F.lower("text"), F.lit("|".join(DOC_TERMS)))
    text = F.concat(F.lit("Documentation at "), F.col("locator"), F.lit(" defines a controlled verification expectation."))
    return _of(hits, DOC_TYPES).where(mentions).select(*_finding("fact", text, 0.84, "observed", "document", **_per_hit("doc-verification", "observed")))


Analyzer = Callable[[DataFrame, AuditRequest], DataFrame]
ANALYZERS: list[Analyzer] = [analyze_logs, analyze_exports, analyze_code, analyze_integrations, analyze_schemas, analyze_query_outputs, analyze_documents]


def observations(hits: DataFrame, request: AuditRequest, analyzers: Sequence[Analyzer] = tuple(ANALYZERS)) -> DataFrame:
    """Findings of every analyzer, with ids."""
    union = None
    for position, analyze in enumerate(analyzers):
        part = analyze(hits, request).withColumn("analyzer_order", F.lit(position))
        union = part if union is None else union.unionByName(part)
    return union.withColumn("finding_id", ids.audit_id("finding", F.col("classification"), F.col("statement"), F.array_join("references", ",")))


def timeline(hits: DataFrame) -> DataFrame:
    """Timestamped points: the first time written in the text, else the ingest time."""
    ingest = F.col("ingest_ts").cast("timestamp")
    points = hits.select(
        extract.event_time(F.col("text"), ingest).alias("timestamp"), T.first_line(F.col("text")).alias("statement"), "source_id", "source_type", "locator",
        extract.correlation_ids(F.col("text")).alias("correlation_ids"), "system_id", F.concat_ws(":", "source_id", "locator").alias("provenance_ref"),
    ).where(F.col("timestamp").isNotNull())
    return points.withColumn("event_id", ids.audit_id("event", F.col("provenance_ref"), F.col("statement")))


TIMELINE_ORDER = ["timestamp", "source_id", "locator"]


def coverage_findings(found: DataFrame, points: DataFrame, request: AuditRequest) -> DataFrame:
    """Findings about the evidence itself: its time span, or that no fact was found."""
    rows = found.select("classification").unionByName(points.select(*TIMELINE_ORDER, "provenance_ref", "source_type"), allowMissingColumns=True)
    point = F.when(F.col("timestamp").isNotNull(), F.struct(*TIMELINE_ORDER, "provenance_ref"))
    one = rows.agg(
        F.size(F.collect_set("classification")).alias("classes"), F.count_if(F.col("classification") == "fact").alias("facts"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"),
        F.array_sort(F.collect_list(point))["provenance_ref"].alias("refs"), _set("source_type").alias("types"),
    )
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    text = F.concat(F.lit("Evidence timeline spans "), iso("t0"), F.lit(" to "), iso("t1"), F.lit("."))
    inferred = one.where((F.col("classes") < 3) & F.col("t0").isNotNull()).select(
        *_finding("inference", text, 0.72, "inferred", "timeline", supporting=F.col("refs"), provenance=F.col("refs"), systems=F.col("types"), time_start=F.col("t0"), time_end=F.col("t1")),
        ids.audit_id("finding", F.lit("timeline"), text, F.lit(request.query)).alias("finding_id"),
    )
    status = "needs_live_verification" if request.live_verification else "unverified"
    nothing = F.lit("No direct fact-level evidence was found for the requested scope.")
    absent = one.where("facts = 0").select(*_finding("missing_evidence", nothing, 0.68, status, "coverage-check"), ids.audit_id("finding", F.lit("missing-fact"), F.lit(request.query)).alias("finding_id"))
    return inferred.unionByName(absent).withColumn("analyzer_order", F.lit(90))


def cross_source_findings(found: DataFrame, hits: DataFrame, request: AuditRequest) -> DataFrame:
    """Frame-to-code fact, a hypothesis when logs and code agree, and a recommendation per gap.

    The hypothesis names the evidence it rests on instead of a fixed scenario.
    """
    q = F.lit(request.query)
    logs, code = _of(hits, ["log"]), _of(hits, ["code"])
    quoted = found.where((F.col("analyzer") == "code") & (F.col("classification") == "fact")).select(F.lit(True).alias("quoted"))
    matched = _frame_matches(logs, code).select("raw", "locator", "code_chunk").unionByName(quoted, allowMissingColumns=True)
    matched = matched.agg(_set("raw").alias("frames"), _set("locator").alias("paths"), _set("code_chunk").alias("chunks"), F.count("quoted").alias("n_quoted"))
    text = F.concat(F.lit("Source code evidence matches the runtime stack frame(s) "), F.array_join("frames", ", "), F.lit("."))
    frame_fact = matched.where((F.size("frames") > 0) & (F.col("n_quoted") == 0)).select(
        *_finding("fact", text, 0.96, "observed", "cross-source-correlation", supporting=F.col("chunks"), provenance=F.col("paths")),
        ids.audit_id("finding", F.lit("source-code"), F.array_join("chunks", ","), q).alias("finding_id"),
    )
    first = lambda cond: F.min_by(F.when(cond, F.struct("statement", "supporting", "provenance", "systems")), F.when(cond, F.struct("analyzer_order", "statement")))
    is_fact = F.col("classification") == "fact"
    everything = found.unionByName(frame_fact.withColumn("analyzer_order", F.lit(80)))
    pieces = everything.agg(
        first(is_fact & F.contains("statement", F.lit("failure signal"))).alias("log"),
        first(is_fact & F.contains("statement", F.lit("Source code evidence matches"))).alias("code"),
        first(is_fact & F.contains("statement", F.lit("Schema evidence identifies"))).alias("schema"),
        first(F.col("classification") == "missing_evidence").alias("gap"),
    )
    both = lambda field: F.array_distinct(F.concat(F.col("log")[field], F.col("code")[field], F.coalesce(F.col("schema")[field], F.array().cast("array<string>"))))
    guess = F.concat(
        F.lit("The runtime failure appears to originate in "), F.array_join(F.col("code.provenance"), ", "), F.lit("."),
        F.when(F.col("schema").isNotNull(), F.concat(F.lit(" The schema evidence suggests it surfaces where records of "), F.array_join(F.col("schema.provenance"), ", "), F.lit(" are expected."))).otherwise(F.lit("")),
    )
    hypothesis = pieces.where(F.col("log").isNotNull() & F.col("code").isNotNull()).select(
        *_finding("hypothesis", guess, 0.74, "unverified", "cross-source-correlation", supporting=both("supporting"), provenance=both("provenance"), systems=both("systems")),
        ids.audit_id("finding", F.lit("hypothesis"), guess, q).alias("finding_id"),
    )
    recommendation = pieces.where(F.col("gap").isNotNull()).select(
        *_finding("recommendation", F.lit(RECOMMENDATION), 0.91, "requested", "verification-planning", supporting=F.col("gap.supporting"), provenance=F.col("gap.provenance"), systems=F.col("gap.systems")),
        ids.audit_id("finding", F.lit("recommendation"), F.col("gap.statement"), q).alias("finding_id"),
    )
    return frame_fact.unionByName(hypothesis).unionByName(recommendation).withColumn("analyzer_order", F.lit(95))


def findings(hits: DataFrame, request: AuditRequest, analyzers: Sequence[Analyzer] = tuple(ANALYZERS)) -> DataFrame:
    """All findings of one audit.

    The number of findings is bounded by the number of hits; they are materialised twice
    because later findings look at all earlier ones.
    """
    found = cut_lineage(observations(hits, request, analyzers).coalesce(1))
    covered = cut_lineage(found.unionByName(coverage_findings(found, timeline(hits), request)).coalesce(1))
    return covered.unionByName(cross_source_findings(covered, hits, request))


FINDING_ORDER = ["analyzer_order", "classification", "statement"]


def class_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def executive_summary(found: DataFrame, request: AuditRequest) -> Column:
    """Aggregate expression for the one-sentence summary."""
    n = lambda c: F.count_if(F.col("classification") == c).cast("string")
    scope = request.scope or request.query[:80]
    return F.concat(
        F.lit(f"Audit scope '{scope}' produced "), n("fact"), F.lit(" fact finding(s), "), n("hypothesis"), F.lit(" hypothesis finding(s), and "), n("missing_evidence"), F.lit(" missing-evidence finding(s).")
    )


def causal_chains(found: DataFrame, points: DataFrame, length: int = 4) -> DataFrame:
    """The first findings and the first timeline anchors as arrow chains."""
    kept = found.where(F.col("classification").isin("fact", "inference", "hypothesis")).orderBy(*FINDING_ORDER).limit(length)
    chain = kept.agg(F.array_sort(F.collect_list(F.struct(*FINDING_ORDER))).alias("f")).select(F.lit("findings").alias("kind"), F.array_join(F.transform("f", lambda x: F.concat(x["classification"], F.lit(":"), x["statement"])), " -> ").alias("chain"))
    anchors = points.orderBy(*TIMELINE_ORDER).limit(length).agg(F.array_sort(F.collect_list(F.struct(*TIMELINE_ORDER, "provenance_ref")))["provenance_ref"].alias("p"))
    timed = anchors.select(F.lit("timeline").alias("kind"), F.concat(F.lit("Timeline anchors are "), F.array_join("p", " -> ")).alias("chain"), F.col("p"))
    return chain.where("chain != ''").unionByName(timed.where(F.size("p") > 0).drop("p"))


def audit_id(request: AuditRequest) -> Column:
    parts = (request.search_terms, request.scope, ",".join(request.systems), ",".join(request.correlation_ids))
    return ids.audit_id("audit", *[F.lit(p) for p in parts])


def report(hits: DataFrame, request: AuditRequest) -> DataFrame:
    """One row: ids, summary, machine report (JSON) and human report (Markdown).

    ``hits`` is bounded by 24 per source type, so the report is small by construction.
    """
    found, points = cut_lineage(findings(hits, request).coalesce(1)), timeline(hits)
    rows = F.array_sort(F.collect_list(F.struct(*FINDING_ORDER, "confidence", "verification_status", "finding_id", "provenance")))
    listed = found.agg(rows.alias("f"), executive_summary(found, request).alias("executive_summary"))
    moments = points.agg(F.array_sort(F.collect_list(F.struct(*TIMELINE_ORDER, "statement", "event_id"))).alias("t"))
    chains = causal_chains(found, points).agg(F.array_sort(F.collect_list("chain")).alias("causal_chains"))
    parts = listed.unionByName(moments, allowMissingColumns=True).unionByName(chains, allowMissingColumns=True)
    joined = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
    line = lambda x: F.format_string("- `%s` [%s] %s\n  - Confidence: %.2f\n  - Verification: %s\n  - Evidence: %s", x["finding_id"], x["classification"], x["statement"], x["confidence"], x["verification_status"], F.coalesce(F.nullif(F.array_join(x["provenance"], ", "), F.lit("")), F.lit("none")))
    point = lambda x: F.concat(F.lit("- `"), x["timestamp"].cast("string"), F.lit("` "), x["statement"], F.lit("\n  - Evidence: `"), x["source_id"], F.lit("` `"), x["locator"], F.lit("`"))
    markdown = F.concat_ws(
        "\n", F.lit("# Failure Audit Report"), F.concat(F.lit("- Audit ID: `"), audit_id(request), F.lit("`")), F.lit(f"- Scope: {request.scope or 'unspecified'}"), F.lit("## Executive Summary"), F.col("executive_summary"),
        F.lit("## Timeline"), F.coalesce(F.nullif(F.array_join(F.transform("t", point), "\n"), F.lit("")), F.lit("- No timestamped evidence located.")), F.lit("## Findings"), F.array_join(F.transform("f", line), "\n"),
    )
    return joined.select(
        audit_id(request).alias("report_id"), F.sha2(F.lit(request.query), 256).alias("request_hash"), "executive_summary", markdown.alias("human_report"),
        F.to_json(F.struct(F.col("f").alias("findings"), F.col("t").alias("timeline"), "causal_chains")).alias("machine_report"), F.col("f")["finding_id"].alias("finding_ids"), F.col("t")["event_id"].alias("timeline_event_ids"),
    )


def verification_requests(found: DataFrame, request: AuditRequest, broker: str = "broker") -> DataFrame:
    """A broker request when evidence is missing or live verification was asked for."""
    gaps = found.agg(F.min(F.when(F.col("classification") == "missing_evidence", F.struct("analyzer_order", "statement", "finding_id")))["finding_id"].alias("finding_id"))
    needed = gaps if request.live_verification else gaps.where(F.col("finding_id").isNotNull())
    payload = F.to_json(F.struct(F.lit("read_select").alias("operation_class"), F.lit(request.search_terms).alias("query"), F.lit("live database data must not be fabricated").alias("reason")))
    return needed.select(ids.audit_id("verify", payload).alias("request_id"), audit_id(request).alias("audit_id"), "finding_id", F.lit(broker).alias("broker_name"), payload.alias("request_payload"), F.lit("pending").alias("status"))


def scoped_audit(chunks: DataFrame, request: AuditRequest, domain_id: str, acl_scopes: Sequence[str], owned_systems: Sequence[str]) -> DataFrame:
    """Audit confined to one domain: its scope is applied before the request is looked at."""
    confined = chunks.where(compile_filters(RetrievalFilters(principal_acl_scopes=tuple(acl_scopes), principal_domain_id=domain_id)))
    narrowed = replace(request, systems=tuple(request.systems) or tuple(owned_systems))
    return findings(audit_hits(confined, narrowed), narrowed)
