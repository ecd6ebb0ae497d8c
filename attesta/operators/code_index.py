"""Code symbols and relationships from source text, line by line, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import extract, ids
from attesta.functions.text import bound, splitlines, strip, unicode_aware

# Declaration and reference patterns, and the body window.
DECLARATIONS = {
    "python": [("class", r"^\s*class\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)")],
    "java": [
        ("class", r"^\s*(?:public\s+|private\s+|protected\s+|final\s+|abstract\s+)*class\s+([A-Za-z_]\w*)"),
        ("method", r"^\s*(?:public|private|protected|static|final|native|synchronized|abstract|\s)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("),
    ],
    "sql": [
        ("table", r"(?i)\bCREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)"),
        ("routine", r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+([\w.]+)"),
    ],
    "powershell": [("function", r"(?i)^\s*function\s+([\w.-]+)")],
}
IMPORTS = r"(?im)^\s*(?:import|from)\s+([\w.:-]+)"
# The first test at a place is what a match may begin with: boundaries and the case folding of alternatives are dear.
CALLS = r"(?=[A-Za-z_])\b([A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)?)\s*+\("
ENDPOINTS = r"(?i)(?=[@DGPdgp])(?:@(?:app|router)\.(?:get|post|put|delete)|(?:GET|POST|PUT|DELETE)\s+)(?:\(|\s+)?[\"']([^\"']+)"
CONFIGURATION = r"(?i)(?=[CEGOcego])(?:os\.environ(?:\.get)?|ENV|Get-Item\s+env:|Configuration(?:Manager)?[.]AppSettings)\s*[(\[]?\s*[\"']([A-Z][A-Z0-9_.-]+)"
LOGGING = r"(?i)(?=[LWlw])(?:\b(?:logger|logging)\.(?:debug|info|warning|error|exception|critical)\b|Write-(?:Verbose|Warning|Error|Information))"
EXCEPTIONS = r"(?i)(?=[CEFTceft])\b(?:try|catch|except|finally)\b"
BODY_LINES = 81


def _declared(sources: DataFrame, with_references: bool = True) -> DataFrame:
    """Files with ``declared``: line, signature, kind, name and references of every declaration, in order.

    References are read from the window after the declaration while the file is still one
    row, so neither the file nor the window is copied per symbol.
    """
    language = extract.language(F.col("source_uri"))

    def matches(line: Column) -> Column:
        found = F.array().cast("array<struct<kind:string,name:string>>")
        for name, patterns in DECLARATIONS.items():
            pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, unicode_aware(p), 1).alias("name")) for kind, p in patterns])
            found = F.when(F.col("language") == name, F.filter(pairs, lambda m: m["name"] != "")).otherwise(found)
        return found

    per_line = F.transform("_lines", lambda line, i: F.struct((i + 1).alias("line_start"), line.alias("line"), matches(line).alias("found")))
    on_lines = F.filter(per_line, lambda x: F.size(x["found"]) > 0)
    none = F.array().cast("array<struct<target:string,relation_type:string>>")
    body = lambda x: F.array_join(F.slice(F.col("_lines"), x["line_start"], F.lit(BODY_LINES)), "\n")
    with_refs = F.transform(on_lines, lambda x: F.struct(x["line_start"], strip(x["line"]).alias("signature"), x["found"], (bound(body(x), references) if with_references else none).alias("refs")))
    each = F.flatten(
        F.transform(
            with_refs,
            lambda x: F.transform(
                x["found"],
                lambda m: F.struct(x["line_start"].alias("line_start"), x["signature"].alias("signature"), m["kind"].alias("kind"), m["name"].alias("name"), x["refs"].alias("refs")),
            ),
        )
    )
    carried = [c for c in sources.columns if c != "content"]
    indexed = sources.withColumns({"language": language, "_lines": splitlines(F.col("content"))}).where(F.col("language").isNotNull())
    return indexed.select(*carried, "language", each.alias("declared"))


def _qualified(declared: Column) -> Column:
    """The declarations with ``qualified_name``: after the last class that an earlier line declares."""

    def name(x: Column, classes: Column) -> Column:
        parent = F.try_element_at(F.filter(classes, lambda c: c["line_start"] < x["line_start"]), F.lit(-1))["name"]
        return F.when(x["kind"].isin("function", "method") & parent.isNotNull(), F.concat_ws(".", parent, x["name"])).otherwise(x["name"])

    def of(bound_: Column) -> Column:
        classes = F.filter(bound_, lambda x: x["kind"] == "class")
        return bound(classes, lambda c: F.transform(bound_, lambda x: x.withField("qualified_name", name(x, c))))

    return bound(declared, of)


def declarations(sources: DataFrame) -> DataFrame:
    """One row per declaration with its line, signature, and qualified name; no shuffle and no references."""
    files = _declared(sources, with_references=False)
    return files.select(*[c for c in files.columns if c != "declared"], F.inline(_qualified(F.col("declared")))).drop("refs")


def _placed(declared: Column, spans: Column) -> Column:
    """The declarations inside a chunk, with ``chunk``: the first, by ordinal, whose lines hold them.

    Chunks without line numbers cover every line.
    """

    def first(x: Column, ordered: Column) -> Column:
        holds = lambda s: (F.coalesce(s["line_start"], F.lit(1)) <= x["line_start"]) & (x["line_start"] <= F.coalesce(s["line_end"], x["line_start"]))
        return F.get(F.filter(ordered, holds), F.lit(0))

    return F.filter(bound(F.array_sort(spans), lambda ordered: F.transform(declared, lambda x: x.withField("chunk", first(x, ordered)))), lambda x: x["chunk"].isNotNull())


def _resolved(declared: Column) -> Column:
    """References that count, and whether the whole target is declared in the file.

    Calls count only when their last name part is.
    """

    def of(known: Column) -> Column:
        counts = lambda r: (r["relation_type"] != "calls") | F.array_contains(known, F.element_at(F.split(r["target"], r"\."), -1))
        seen = lambda refs: F.transform(F.filter(refs, counts), lambda r: r.withField("resolved", F.array_contains(known, r["target"])))
        return F.transform(declared, lambda x: x.withField("refs", seen(x["refs"])))

    names = F.array_distinct(F.concat(F.transform(declared, lambda x: x["name"]), F.transform(declared, lambda x: x["qualified_name"])))
    return bound(names, of)


def file_symbols(sources: DataFrame, chunks: DataFrame, with_references: bool = True) -> DataFrame:
    """Declarations inside the chunks of their file, with ``chunk`` and resolved ``refs``.

    A file and its chunks' line ranges meet in one row: both kinds of rows go through one aggregate
    by version, so there is one exchange. Files cross it whole and are searched behind it, because
    a table of small files may be read by a single task. What depends on the whole file (the class
    around a method, the names declared in it) is looked up in that row. A class outside every
    chunk names no parent.
    """
    key = "source_version_id"
    carried = [c for c in sources.columns if c != key]
    files = sources.where(extract.language(F.col("source_uri")).isNotNull()).select(key, F.struct(*carried).alias("file"))
    spans = chunks.select(key, F.struct(F.col("ordinal").alias("ordinal"), "chunk_id", "locator", "line_start", "line_end").alias("span"))
    missing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = files.select(key, "file", missing(spans, "span")).unionByName(spans.select(key, missing(files, "file"), "span"))
    met = both.groupBy(key).agg(F.first("file", ignorenulls=True).alias("file"), F.collect_list("span").alias("_spans")).where(F.col("file").isNotNull())
    found = _declared(met.select(key, *[F.col(f"file.{c}").alias(c) for c in carried], "_spans"), with_references)
    whole = bound(bound(_placed(F.col("declared"), F.col("_spans")), _qualified), _resolved)
    return found.select(*[c for c in found.columns if c not in ("_spans", "declared")], F.inline(whole))


def symbols(sources: DataFrame, chunks: DataFrame, with_references: bool = True) -> DataFrame:
    """Symbol rows of ``sources`` (``source_version_id, source_uri, content`` and scope columns).

    Without references ``refs`` is empty and the bodies of the symbols are not searched.
    """
    line = F.col("line_start").cast("string")
    return file_symbols(sources, chunks, with_references).withColumns(
        {
            "symbol_id": ids.index_id("sym", F.col("source_version_id"), F.col("qualified_name"), line),
            "chunk_id": F.col("chunk.chunk_id"),
            "locator": F.concat(F.col("chunk.locator"), F.lit(":L"), line),
            "line_end": F.col("line_start"),
        }
    ).drop("chunk")


def references(body: Column) -> Column:
    """ARRAY<STRUCT<target, relation_type>> of the references in a body window, distinct."""
    found = lambda p: F.regexp_extract_all(body, F.lit(unicode_aware(p)), F.lit(1))
    tagged = lambda names, relation: F.transform(names, lambda n: F.struct(n.alias("target"), F.lit(relation).alias("relation_type")))
    flag = lambda p, target: F.when(F.rlike(body, F.lit(unicode_aware(p))), F.array(F.lit(target))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(
            tagged(found(IMPORTS), "imports"), tagged(found(CALLS), "calls"), tagged(found(ENDPOINTS), "endpoint"), tagged(found(CONFIGURATION), "configuration"),
            tagged(flag(LOGGING, "logging"), "logging"), tagged(flag(EXCEPTIONS, "exception-handling"), "exception_handling"),
        )
    )


def relationships(symbols_: DataFrame) -> DataFrame:
    """References of each symbol, one row each; ``symbols_`` still carries ``refs``, so nothing is joined."""
    carried = [c for c in symbols_.columns if c not in ("refs", "name", "qualified_name", "kind", "signature", "line_start", "line_end")]
    rows = symbols_.select(*carried, F.inline("refs"))
    return rows.withColumn("relationship_id", ids.index_id("rel", F.col("symbol_id"), F.col("relation_type"), F.col("target")))


def search_symbols(symbols_: DataFrame, query: str, limit: int | None, ordered: bool = True) -> DataFrame:
    """Symbols whose name, qualified name or kind contains any query term; no term matches all."""
    import re

    terms = {t.lower() for t in re.findall(r"[A-Za-z0-9_.-]+", query)}
    hit = F.lit(not terms)
    for term in sorted(terms):
        for column in ("name", "qualified_name", "kind"):
            hit = hit | F.contains(F.lower(column), F.lit(term))
    found = symbols_.where(hit)
    if ordered:
        found = found.orderBy(F.lower("name"), "source_version_id", "line_start")
    return found if limit is None else found.limit(max(1, limit))


def matched_symbols(symbols_: DataFrame, query: str) -> DataFrame:
    """All found symbols with their match: exact (0 or 1) + matched terms / terms."""
    import re

    terms = sorted({t.lower() for t in re.findall(r"[\w./:-]+", query)})
    names = [F.lower(c) for c in ("name", "qualified_name", "kind")]
    matched = F.lit(0)
    for term in terms:
        matched = matched + F.greatest(*[F.contains(n, F.lit(term)).cast("int") for n in names])
    exact = F.greatest(*[(n == query.lower()).cast("double") for n in names])
    return search_symbols(symbols_, query, None, ordered=False).withColumn("match", exact + matched / F.lit(float(max(1, len(terms)))))


def match_strengths(symbols_: DataFrame, query: str) -> DataFrame:
    """(match, symbols, best_position): how many symbols match how well, and the rank each strength starts at.

    A strength starts after all stronger symbols, so the counts of the strengths (as many as the
    query has terms) give the ranks of all symbols without numbering them.
    """
    counted = matched_symbols(symbols_, query).groupBy("match").agg(F.count(F.lit(1)).alias("symbols"))
    stronger = Window.orderBy(F.desc("match")).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("best_position", F.coalesce(F.sum("symbols").over(stronger), F.lit(0).cast("long")) + 1)


def rank_symbols(symbols_: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best chunks of a symbol-aware ranking: a chunk scores 1 / position of its first symbol.

    All found symbols are ranked by (match, name, line), all descending, and collapsed to chunks
    before the limit; the positions of the chunks it leaves follow from counts.
    """
    keys = ["match", "folded", "line_start", "source_version_id", "chunk_id"]
    order = [F.desc("match"), F.desc("folded"), F.desc("line_start"), F.asc("source_version_id"), F.asc("chunk_id")]
    found = matched_symbols(symbols_, query).select("match", F.lower("name").alias("folded"), "line_start", "source_version_id", "chunk_id")
    first = found.where("chunk_id is not null").withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).where("nth = 1").drop("nth")
    best = first.orderBy(*order).limit(max(1, int(limit))).select(F.struct(*keys).alias("best"))
    ahead, level = F.lit(False), F.lit(True)
    for k in keys:
        own = F.col(f"best.{k}")
        better = F.coalesce(F.col(k) > own, own.isNull() & F.col(k).isNotNull())  # nulls come last in a descending order
        if k in ("source_version_id", "chunk_id"):
            better = F.coalesce(F.col(k) < own, F.col(k).isNull() & own.isNotNull())  # and first in an ascending one
        ahead = ahead | (level & F.coalesce(better, F.lit(False)))
        level = level & F.col(k).eqNullSafe(own)
    placed = found.crossJoin(F.broadcast(best)).groupBy("best").agg(F.count_if(ahead).alias("before"))  # a best symbol is itself among the found
    return placed.select(F.col("best.chunk_id").alias("chunk_id"), (F.lit(1.0) / (F.col("before") + 1)).alias("score"))
