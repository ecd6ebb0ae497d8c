"""Retrieval benchmark: rank every query, compare with the relevant sources, summarise."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import ranking
from attesta.operators.filters import RetrievalFilters, compile_filters
from attesta.session import cut_lineage
from attesta.sources import corpus

# Benchmark modes and cut-off.
MODES = ["lexical", "vector", "hybrid", "symbol_aware"]
DEFAULT_K = 5

WORD = r"[\p{L}\p{N}_]+"
SHORT_BLOCK = 500

BENCH_SCOPE = RetrievalFilters(principal_acl_scopes=("internal", "public"), limit=DEFAULT_K, neighbor_window=0)


def scoped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).where(compile_filters(BENCH_SCOPE)).select("chunk_id", "source_id", "ordinal", "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def rank_lexical(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top-k per query by term postings, rarest terms first, for any number of queries."""
    return ranking.rank_many_by_term(chunks, queries, k)


def relevance(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source_id) pairs where a chunk's text contains the query passage verbatim.

    Every word of a passage but the first and the last is a whole word of a text that contains
    it. So a passage is joined on the rarest of these, its anchor, and then compared in full.
    Passages too short to have one are compared with all texts, in blocks.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    asked = queries.where(F.length("text") > 0).select("query_id", F.col("text").alias("passage"), words.alias("words"))
    inner = asked.where(F.size("words") > 2).select("query_id", F.explode(F.array_distinct(F.slice("words", F.lit(2), F.size("words") - 2))).alias("word"))
    # texts are taken apart once; words that no passage is joined on go no further
    offered = cut_lineage(chunks.select("source_id", F.explode(F.array_distinct(words)).alias("word")).join(inner.select("word").distinct(), "word"))
    often = offered.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a word without any occurrence makes the best anchor: it rules its passage out
    anchors = inner.join(often, "word", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    meeting = offered.join(anchors, "word").select("query_id", "source_id").distinct()
    both = meeting.join(asked.select("query_id", "passage"), "query_id").join(chunks.select("source_id", "text"), "source_id")
    found = both.where(F.contains("text", F.col("passage"))).select("query_id", "source_id")
    for block in short_passages(asked):
        literal = F.array(*[F.struct(F.lit(name).alias("query_id"), F.lit(passage).alias("passage")) for name, passage in block])
        pairs = chunks.select("source_id", F.explode(F.filter(literal, lambda q: F.contains(F.col("text"), q["passage"]))).alias("q")).select("q.query_id", "source_id")
        found = found.unionByName(pairs)
    return found.distinct()


def short_passages(asked: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Passages of at most two words, in blocks of about SHORT_BLOCK."""
    short = asked.where(F.size("words") <= 2).select("query_id", "passage")
    blocks = -(-short.count() // SHORT_BLOCK)
    for part in range(blocks):
        rows = short.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part).collect()
        if rows:
            yield [(r.query_id, r.passage) for r in rows]


def query_metrics(ranked: DataFrame, relevant: DataFrame, k: int = DEFAULT_K, chunks: DataFrame | None = None) -> DataFrame:
    """Recall flag, reciprocal rank and result size of every query that has a relevant source.

    ``ranked`` holds at most k rows per query. Its chunk ids name single-chunk sources unless a
    ``source_id`` column says otherwise.
    """
    hits = ranked if "source_id" in ranked.columns else ranked.withColumn("source_id", F.col("chunk_id"))
    marked = hits.join(relevant.withColumn("relevant", F.lit(True)).distinct(), ["query_id", "source_id"], "left")
    first = F.min(F.when(F.col("relevant") & (F.col("rank") <= k), F.col("rank")))
    metrics = marked.groupBy("query_id").agg(first.alias("first_relevant_rank"), F.count(F.lit(1)).alias("returned_chunks"))
    judged = relevant.select("query_id").distinct()
    return metrics.join(judged, "query_id", "left_semi").select(
        "query_id",
        F.when(F.col("first_relevant_rank").isNull(), F.lit(0.0)).otherwise(F.lit(1.0)).alias("recall_at_k"),
        F.coalesce(F.lit(1.0) / F.col("first_relevant_rank"), F.lit(0.0)).alias("mrr"),
        "first_relevant_rank",
        "returned_chunks",
    )


def summarize(metrics: DataFrame) -> DataFrame:
    """Per mode: counts and rounded means and medians."""
    optional = [
        (F.round(F.median("latency_ms"), 3), "median_latency_ms", "latency_ms"),
        (F.round(F.avg("context_tokens"), 3), "mean_context_tokens", "context_tokens"),
    ]
    extra = [expr.alias(name) for expr, name, needs in optional if needs in metrics.columns]
    return metrics.groupBy("mode").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.round(F.avg("recall_at_k"), 6).alias("recall_at_k"),
        F.round(F.avg("mrr"), 6).alias("mrr"),
        F.round(F.median("returned_chunks"), 3).alias("median_returned"),
        F.round(F.avg("returned_chunks"), 3).alias("mean_returned_chunks"),
        *extra,
    )


def run(
    chunks: DataFrame, embeddings: DataFrame, symbols: DataFrame, queries: DataFrame, space: str, k: int = DEFAULT_K, filters: RetrievalFilters = RetrievalFilters()
) -> tuple[DataFrame, DataFrame]:
    """All four modes over a store's tables: ranked chunks and per-query metrics.

    ``queries`` has ``query_id, text, relevant_source_ids, modes``. Lexical, vector and hybrid
    rank every query in one pass over the chunks; chunk and vector meet in one join on the
    chunk id. Symbol-aware ranking runs per query over the (much smaller) symbol table.
    """
    from attesta.functions import text as T
    from attesta.functions.vectors import hash_vector
    from attesta.operators.code_index import rank_symbols

    dimension = int(space.split(":")[-2])
    allowed = chunks.where(compile_filters(filters)).select("chunk_id", "source_id", "ordinal", "text")
    vectors = embeddings.where(F.col("embedding_space_id") == space).select("chunk_id", "vector")
    embedded = allowed.join(vectors, "chunk_id")

    def asked(mode: str) -> DataFrame:
        return queries.where(F.array_contains("modes", mode)).select("query_id", "text")

    def with_vectors(mode: str) -> Iterator[ranking.Query]:
        for rows in ranking.query_blocks(asked(mode)):
            yield from (ranking.Query(r.query_id, r.text, hash_vector(r.text, dimension)) for r in rows)

    lexical = rank_lexical(allowed, asked("lexical"), k).select("query_id", "chunk_id", "ordinal", F.col("score").alias("lexical"), F.lit(0.0).alias("semantic"), "score", "rank")
    parts = [
        lexical.withColumn("mode", F.lit("lexical")),
        ranking.rank_many(embedded, with_vectors("vector"), k, vector="vector").withColumn("mode", F.lit("vector")),
        ranking.rank_many(embedded, with_vectors("hybrid"), k, text="text", vector="vector").withColumn("mode", F.lit("hybrid")),
    ]
    for query in with_vectors("symbol_aware"):
        hits = rank_symbols(symbols.join(allowed.select("chunk_id"), "chunk_id", "left_semi"), query.text, k).join(allowed, "chunk_id")
        scored = hits.select(
            F.lit(query.query_id).alias("query_id"), "chunk_id", "ordinal", T.lexical_score(F.col("text"), T.query_terms(query.text)).alias("lexical"),
            F.lit(0.0).alias("semantic"), "score",
        )
        parts.append(ranking.top_k_per(scored, ["query_id"], k).withColumn("mode", F.lit("symbol_aware")))
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    located = ranked.join(allowed.select("chunk_id", "source_id", T.word_token_count(F.col("text")).alias("tokens")), "chunk_id")
    relevant = queries.select("query_id", F.explode("relevant_source_ids").alias("source_id"))
    metrics = None
    for mode in MODES:
        hits = located.where(F.col("mode") == mode)
        judged = query_metrics(hits.select("query_id", "chunk_id", "source_id", "rank"), relevant, k)
        from attesta.plans.retrieval import context_per

        context = context_per(hits, ["query_id"]).select("query_id", F.col("context.tokens").alias("context_tokens"))
        part = judged.join(context, "query_id").withColumn("mode", F.lit(mode))
        metrics = part if metrics is None else metrics.unionByName(part)
    return located, metrics
