"""Code index with one row per file: the class around a method, chunks and names are looked up in the row."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.operators import code_index

SF = "/root/testdata/sf0.01"
SPANS = "source_version_id string, chunk_id string, ordinal long, locator string, line_start int, line_end int"


def exchanges(df):
    return len(re.findall(r"(?m)^[^A-Za-z]*Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def scans(df):
    return len(re.findall(r"FileScan parquet", df._jdf.queryExecution().executedPlan().toString()))


def test_two_scans_one_exchange_no_window(spark):
    for name in ("code_symbols", "code_relationships", "symbol_chunk_attach"):
        df = entry.queries()[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert exchanges(df) <= 1 and scans(df) <= 2 and "Window" not in plan and "Join" not in plan, name
    assert exchanges(entry.queries()["code_symbol_search"](spark, SF)) == 0  # qualified names need no shuffle


def brute(content, spans):
    """(name, qualified name, line, chunk) of a Python file, and its counting references, by plain loops."""
    found, lines = [], content.splitlines()
    for n, line in enumerate(lines, 1):
        for kind, pattern in code_index.DECLARATIONS["python"]:
            m = re.search(pattern, line)
            chunk = next((c for _, c, lo, hi in sorted(spans) if (lo or 1) <= n <= (hi or n)), None) if m else None
            if chunk:
                parents = [x[0] for x in found if x[4] == "class" and x[2] < n]
                found.append((m[1], f"{parents[-1]}.{m[1]}" if kind == "function" and parents else m[1], n, chunk, kind))
    known = {x[0] for x in found} | {x[1] for x in found}
    refs = set()
    for name, full, n, chunk, _ in found:
        body = "\n".join(lines[n - 1 : n + 80])
        refs |= {(full, n, "imports", t, t in known) for t in re.findall(code_index.IMPORTS, body)}
        refs |= {(full, n, "calls", t, t in known) for t in re.findall(code_index.CALLS, body) if t.split(".")[-1] in known}
    return {x[:4] for x in found}, refs


def test_equals_plain_loops(spark):
    long = "class Big:\n" + "".join(f"    def m{i}(self):\n        return m{(i * 7) % 120}(Big.m{i}())\n" for i in range(120))
    files = {
        "v1": ("import os\ndef free():\n    pass\nclass A:\n  def one(self): return two(self.free())\nclass B(A):\n  async def two(self):\n    B.two(); free()\n", [(0, "k0", 1, 4), (1, "k1", 5, 6), (2, "k2", 6, 8)]),
        "v2": ("class Outside:\n  def inside(self): other(inside())\n", [(0, "k3", 2, 9)]),  # the class is in no chunk and is no parent
        "v3": (long, [(1, "k5", None, None), (0, "k4", 100, 140)]),
        "v4": ("def nowhere(): pass\n", []),
        "v5": ("", [(0, "k6", 1, 1)]),
    }
    sources = spark.createDataFrame([(v, f"src/{v}.py", c) for v, (c, _) in files.items()], "source_version_id string, source_uri string, content string").repartition(3)
    chunks = spark.createDataFrame([(v, k, o, "loc", lo, hi) for v, (_, spans) in files.items() for o, k, lo, hi in spans], SPANS)
    symbols = code_index.symbols(sources, chunks)
    rows, relations = symbols.collect(), code_index.relationships(symbols.withColumn("q", symbols["qualified_name"]).withColumn("n", symbols["line_start"])).collect()
    for version, (content, spans) in files.items():
        want, refs = brute(content, spans)
        assert {(r.name, r.qualified_name, r.line_start, r.chunk_id) for r in rows if r.source_version_id == version} == want
        assert {(r.q, r.n, r.relation_type, r.target, r.resolved) for r in relations if r.source_version_id == version and r.relation_type in ("imports", "calls")} == refs
    assert {r.locator for r in rows if r.qualified_name == "A.one"} == {"loc:L5"}


def test_files_are_searched_behind_the_exchange(spark):
    """A table that one task reads is searched by all: no pattern is looked for below the exchange."""
    for name in ("code_symbols", "code_relationships"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Aggregate [source_version_id", 1)
        assert "async" in above and "async" not in below, name


def test_references_begin_where_they_did(spark):
    """Patterns that test the first character of a match first find the same matches."""
    plain = {
        "calls": r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\s*\(",
        "endpoint": r"(?i)(?:@(?:app|router)\.(?:get|post|put|delete)|(?:GET|POST|PUT|DELETE)\s+)(?:\(|\s+)?[\"']([^\"']+)",
        "configuration": r"(?i)(?:os\.environ(?:\.get)?|ENV|Get-Item\s+env:|Configuration(?:Manager)?[.]AppSettings)\s*[(\[]?\s*[\"']([A-Z][A-Z0-9_.-]+)",
    }
    flags = {"logging": r"(?i)\b(?:logger|logging)\.(?:debug|info|warning|error|exception|critical)\b|Write-(?:Verbose|Warning|Error|Information)", "exception_handling": r"(?i)\b(?:try|catch|except|finally)\b"}
    bodies = [
        "a.b.c (x) é.f(1) fé(2) _g\n(3) h . i(4) 5j(6) k.7(8)", "@App.GET('/x') poſt \"/y\" DELETE   (\"/z\") xput '/w'", "OS.environ.get('KEY') env[\"K2\"] os.envİron('K3') ConfigurationManager.AppSettings[\"K.4\"] get-item env: 'K5'",
        "mylogger.error(x)", "LOGGER.Info", "xWrite-verbose", "retry", "caſch fINALLY", "", "logging.criticalx", "écatch", "TRY",
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "body string").select(
        "body", code_index.references(F.col("body")).alias("refs"),
        *[F.array_distinct(F.regexp_extract_all("body", F.lit("(?U)" + p), F.lit(1))).alias(n) for n, p in plain.items()], *[F.rlike("body", F.lit("(?U)" + p)).alias(n) for n, p in flags.items()],
    )
    for r in df.collect():
        for name in plain:
            assert [x.target for x in r.refs if x.relation_type == name] == r[name], (name, r.body)
        assert {x.relation_type for x in r.refs} & set(flags) == {n for n in flags if r[n]}, r.body
