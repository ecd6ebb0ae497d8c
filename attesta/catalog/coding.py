"""Code symbols, relationships and symbol-aware search."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.operators import code_index, ranking
from attesta.sources import blocks, corpus


def _sources(spark, sf_dir):
    return corpus.code(spark, sf_dir).select("source_version_id", "source_uri", F.col("text").alias("content"), "domain_id")


def _chunks(spark, sf_dir):
    code = corpus.code(spark, sf_dir).select("source_version_id", "source_uri", "text")
    return blocks.with_chunk_identity(blocks.explode_blocks(code, blocks.chunk_blocks(F.col("text"), 90), ["source_version_id", "source_uri"]))


_DECL = f"""code AS ({S.CODE}), lines AS (SELECT source_version_id, source_uri, i AS n, string_split(text, chr(10))[i] AS line FROM code, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)),
 decl AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*class\\s') THEN 'class' ELSE 'function' END AS kind, regexp_extract(line, '^\\s*(?:class|def)\\s+([A-Za-z_]\\w*)', 1) AS name FROM lines WHERE regexp_matches(line, '^\\s*(?:class|def)\\s+[A-Za-z_]')),
 qual AS (SELECT *, last_value(CASE WHEN kind = 'class' THEN name END IGNORE NULLS) OVER (PARTITION BY source_version_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM decl),
 sym AS (SELECT *, CASE WHEN kind = 'function' AND parent IS NOT NULL THEN parent || '.' || name ELSE name END AS qualified_name FROM qual)"""


@query(
    "code_symbols",
    f"WITH {_DECL} SELECT source_version_id, n AS line_start, kind, name, qualified_name, trim(line) AS signature, 'sym_' || left(sha256(source_version_id || chr(0) || qualified_name || chr(0) || n), 32) AS symbol_id FROM sym",
)
def code_symbols(spark, sf_dir):
    rows = code_index.symbols(_sources(spark, sf_dir), _chunks(spark, sf_dir), with_references=False)
    return rows.select("source_version_id", F.col("line_start").cast("long").alias("line_start"), "kind", "name", "qualified_name", "signature", "symbol_id")


@query(
    "symbol_chunk_attach",
    f"""WITH RECURSIVE {_DECL}, {S.chunker('code', 'source_version_id', 90, False).replace('lines AS', 'cl AS').replace('FROM lines', 'FROM cl').replace('JOIN lines', 'JOIN cl')},
 spans AS (SELECT source_version_id, line_start, line_end, row_number() OVER (PARTITION BY source_version_id ORDER BY line_start) - 1 AS ordinal FROM blocks)
 SELECT s.source_version_id, s.n AS line_start, s.name, min(b.ordinal) AS ordinal FROM sym s JOIN spans b ON b.source_version_id = s.source_version_id AND s.n BETWEEN b.line_start AND b.line_end GROUP BY 1, 2, 3""",
)
def symbol_chunk_attach(spark, sf_dir):
    attached = code_index.file_symbols(_sources(spark, sf_dir), _chunks(spark, sf_dir), with_references=False)
    return attached.select("source_version_id", F.col("line_start").cast("long").alias("line_start"), "name", F.col("chunk.ordinal").cast("long").alias("ordinal"))


_REL = f"""{_DECL}, body AS (SELECT s.source_version_id, s.qualified_name, s.n, string_agg(l.line, chr(10) ORDER BY l.n) AS body FROM sym s JOIN lines l ON l.source_version_id = s.source_version_id AND l.n BETWEEN s.n AND s.n + 80 GROUP BY 1, 2, 3),
 known AS (SELECT source_version_id, name AS k FROM sym UNION SELECT source_version_id, qualified_name FROM sym),
 refs AS (SELECT source_version_id, qualified_name, n, unnest(regexp_extract_all(body, '\\b([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)?)\\s*\\(', 1)) AS target, 'calls' AS relation_type FROM body
   UNION ALL SELECT source_version_id, qualified_name, n, unnest(regexp_extract_all(body, '(?im)^\\s*(?:import|from)\\s+([\\w.:-]+)', 1)), 'imports' FROM body
   UNION ALL SELECT source_version_id, qualified_name, n, 'logging', 'logging' FROM body WHERE regexp_matches(body, 'logger\\.error')
   UNION ALL SELECT source_version_id, qualified_name, n, 'exception-handling', 'exception_handling' FROM body WHERE regexp_matches(body, '\\b(try|except)\\b')),
 rel AS (SELECT DISTINCT r.* FROM refs r WHERE relation_type <> 'calls' OR EXISTS (SELECT 1 FROM known k WHERE k.source_version_id = r.source_version_id AND k.k = string_split(r.target, '.')[-1]))"""


@query(
    "code_relationships",
    f"""WITH {_REL} SELECT source_version_id, 'sym_' || left(sha256(source_version_id || chr(0) || qualified_name || chr(0) || n), 32) AS symbol_id, relation_type, target,
  EXISTS (SELECT 1 FROM known k WHERE k.source_version_id = rel.source_version_id AND k.k = rel.target) AS resolved FROM rel""",
)
def code_relationships(spark, sf_dir):
    symbols = code_index.symbols(_sources(spark, sf_dir), _chunks(spark, sf_dir))
    return code_index.relationships(symbols).select("source_version_id", "symbol_id", "relation_type", "target", "resolved")


@query(
    "code_symbol_search",
    f"""WITH {_DECL} SELECT source_version_id, n AS line_start, name, kind FROM sym WHERE contains(lower(name), 'size_1') OR contains(lower(qualified_name), 'size_1') OR contains(lower(kind), 'size_1') OR contains(lower(name), 'part77') OR contains(lower(qualified_name), 'part77')
 ORDER BY lower(name), source_version_id, n LIMIT 50""",
)
def code_symbol_search(spark, sf_dir):
    symbols = code_index.declarations(_sources(spark, sf_dir))
    found = code_index.search_symbols(symbols, "Size_1 / part77", 50)
    return found.select("source_version_id", F.col("line_start").cast("long").alias("line_start"), "name", "kind")


@query(
    "bench_rank_symbols",
    f"""WITH {_DECL}, t AS (SELECT ['size_7', 'part7', 'class'] AS terms), found AS (SELECT sym.*, list_sum(list_transform(t.terms, lambda x: (contains(lower(name), x) OR contains(lower(qualified_name), x) OR contains(kind, x))::INT))::DOUBLE / 3 AS match FROM sym, t),
 pos AS (SELECT *, row_number() OVER (ORDER BY match DESC, lower(name) DESC, n DESC, source_version_id) AS position FROM found WHERE match > 0)
 SELECT match, count(*) AS symbols, min(position) AS best_position FROM pos GROUP BY match""",
)
def bench_rank_symbols(spark, sf_dir):
    """Match strength of the symbols found for one query and the rank each strength starts at."""
    symbols = code_index.declarations(_sources(spark, sf_dir)).withColumn("chunk_id", F.concat_ws("#", "source_version_id", "line_start"))
    return code_index.match_strengths(symbols, "Size_7 Part7 class")


@query(
    "symbols_per_chunk",
    f"WITH {_DECL} SELECT source_version_id, string_agg(qualified_name, ',' ORDER BY n, qualified_name) AS symbol_names FROM sym GROUP BY 1",
)
def symbols_per_chunk(spark, sf_dir):
    """Qualified names declared per source version, attached to its code chunk."""
    symbols = code_index.declarations(_sources(spark, sf_dir))
    names = symbols.groupBy("source_version_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "qualified_name")))["qualified_name"].alias("names"))
    attached = corpus.code(spark, sf_dir).select("source_version_id").join(names, "source_version_id", "left")
    return attached.select("source_version_id", F.array_join("names", ",").alias("symbol_names"))
