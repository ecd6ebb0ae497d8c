"""Hybrid retrieval over chunk and embedding tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions import vectors as V
from attesta.operators import ranking
from attesta.operators.filters import RetrievalFilters, compile_filters
from attesta.session import cut_lineage


class EmbeddingSpaceMismatch(ValueError):
    """A query space has no vectors for chunks that are indexed in another space."""


def ranked(top: DataFrame) -> DataFrame:
    """Add the rank to a top-k result (its size is the limit, so one task numbers it)."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*ranking.rank_order())).cast("long"))


def hybrid_scores(
    chunks: DataFrame,
    embeddings: DataFrame,
    query: str,
    query_vector: Sequence[float],
    filters: RetrievalFilters,
    *,
    vector: str = "vector",
    weights: tuple[float, float] = (ranking.SEMANTIC_WEIGHT, ranking.LEXICAL_WEIGHT),
) -> DataFrame:
    """``chunk_id, ordinal, lexical_score, semantic_score, score`` of every allowed chunk.

    The scope predicate runs first. Each side is reduced to its score before the join, so
    the shuffle carries ids and doubles and never texts or vectors. Chunks without a
    vector keep a semantic score of 0.
    """
    allowed = chunks.where(compile_filters(filters))
    lexical = allowed.select("chunk_id", "ordinal", T.lexical_score(F.col("text"), T.query_terms(query)).alias("lexical_score"))
    semantic = embeddings.select("chunk_id", V.cosine_to(F.col(vector), query_vector).alias("semantic_score"))
    joined = lexical.join(semantic, "chunk_id", "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    return joined.withColumn("score", ranking.hybrid_score(F.col("semantic_score"), F.col("lexical_score"), *weights))


def narrow_scores(
    allowed: DataFrame,
    query: str,
    keys: Sequence[str] = (),
    *,
    embeddings: DataFrame | None = None,
    query_vector: Sequence[float] = (),
    vector: str = "vector",
    weights: tuple[float, float] = (ranking.SEMANTIC_WEIGHT, ranking.LEXICAL_WEIGHT),
) -> DataFrame:
    """``chunk_id, ordinal``, the keys and the scores of chunks that are already in scope.

    No text and no vector is left in these rows. Without ``embeddings``, and for chunks without a
    vector, the semantic score is 0.
    """
    rows = allowed.select("chunk_id", "ordinal", *keys, T.lexical_score(F.col("text"), T.query_terms(query or " ")).alias("lexical_score"))
    if embeddings is None:
        rows = rows.withColumn("semantic_score", F.lit(0.0))
    else:
        semantic = embeddings.select("chunk_id", V.cosine_to(F.col(vector), query_vector).alias("semantic_score"))
        rows = rows.join(semantic, "chunk_id", "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    return rows.withColumn("score", ranking.hybrid_score(F.col("semantic_score"), F.col("lexical_score"), *weights))


def fetch(allowed: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of a few ranked chunks, with the scores and ranks they were found with.

    ``best`` is a materialised top-k; its ids are a literal predicate of the second scan up to
    ``LITERAL_LOOKUP`` rows, and a semi-join beyond.
    """
    new = [c for c in best.columns if c == "chunk_id" or c not in allowed.columns]
    return _rows_of(allowed, best, "chunk_id", best.count()).join(best.select(*new), "chunk_id")


def hybrid_best(allowed: DataFrame, query: str, k: int, keys: Sequence[str] = (), **side) -> DataFrame:
    """The best ``k`` chunks in scope, or of every group of ``keys``, ranked on narrow rows and then fetched.

    ``keys`` may name a group that holds most of the corpus: each task keeps k rows a group before
    the shuffle, and what is shuffled are ids and numbers.
    """
    scores = narrow_scores(allowed, query, keys, **side)
    best = ranking.top_k_per(scores, keys, k) if keys else ranked(ranking.top_k(scores, k))
    return fetch(allowed, cut_lineage(best))


def space_mismatches(chunks: DataFrame, embeddings: DataFrame, space: str) -> DataFrame:
    """Chunks that have a vector in some other space but none in ``space``."""
    here = F.col("embedding_space_id") == space
    missing = chunks.join(embeddings.where(here).select("chunk_id"), "chunk_id", "left_anti")
    return missing.join(embeddings.where(~here).select("chunk_id"), "chunk_id", "left_semi")


def context_per(hits: DataFrame, keys: Sequence[str], max_chunks: int = ranking.CONTEXT_CHUNKS, max_tokens: int = ranking.CONTEXT_TOKENS) -> DataFrame:
    """Compacted context of each ranked list; ``hits`` is a per-key top-k with ``rank, tokens``."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("tokens").cast("long").alias("tokens"))))
    return hits.groupBy(*keys).agg(ordered.alias("ranked")).select(*keys, ranking.compact_context(F.col("ranked"), max_chunks, max_tokens).alias("context"))


# Top-k results up to this size are looked up by literal keys, larger ones by join.
LITERAL_LOOKUP = 500


def _rows_of(table: DataFrame, keys: DataFrame, column: str, bound: int) -> DataFrame:
    """Rows of a large table for a few keys.

    A bounded key list becomes an IN predicate, which the scan checks against Parquet
    statistics and bloom filters and so skips most row groups; beyond that it is a semi-join.
    """
    if bound > LITERAL_LOOKUP:
        return table.join(keys.select(column).distinct(), column, "left_semi")
    return table.where(F.col(column).isin([r[0] for r in keys.select(column).distinct().collect()]))


def search(
    chunks: DataFrame,
    embeddings: DataFrame,
    query: str,
    filters: RetrievalFilters,
    *,
    active_space: str,
    query_vector: Sequence[float] | None = None,
    neighbors: str = "expanded",
    check_space: bool = True,
) -> DataFrame:
    """Ranked evidence hits with text and scope.

    The top-k is found on narrow rows, materialised (it has at most ``limit`` rows) and only
    then looked up in the chunk table. ``neighbors`` is ``"expanded"`` to add the surrounding
    chunks, or ``"none"``.
    """
    f = replace(filters.normalized(), embedding_space_id=filters.embedding_space_id or active_space)
    vector = query_vector if query_vector is not None else V.hash_vector(query, int(f.embedding_space_id.split(":")[1]))
    allowed = chunks.where(compile_filters(f))
    in_space = embeddings.where(F.col("embedding_space_id") == f.embedding_space_id)
    # Other spaces are other partitions: with a single space there is nothing to compare.
    if check_space and not embeddings.where(F.col("embedding_space_id") != f.embedding_space_id).isEmpty():
        stray = space_mismatches(allowed.select("chunk_id"), embeddings, f.embedding_space_id).limit(3).collect()
        if stray:
            raise EmbeddingSpaceMismatch(f"space {f.embedding_space_id} has no vectors for {[r.chunk_id for r in stray]}")
    top = cut_lineage(ranking.top_k(hybrid_scores(chunks, in_space, query, vector, f), f.limit))
    located = _rows_of(allowed, top, "chunk_id", f.limit).join(top.drop("ordinal"), "chunk_id")
    if neighbors == "none" or f.neighbor_window == 0:
        return located.withColumn("neighboring_chunk_ids", F.array().cast("array<string>"))
    hits = cut_lineage(ranked(located))
    # Chunks of the hit versions are the only possible neighbours.
    around = _rows_of(allowed, hits, "source_version_id", f.limit)
    near = _near(hits, around, f.neighbor_window)
    vectors = _rows_of(in_space, near, "chunk_id", f.limit * (2 * f.neighbor_window + 1))
    scored = near.join(vectors.select("chunk_id", V.cosine_to(F.col("vector"), vector).alias("semantic_score")), "chunk_id", "left")
    detailed = scored.withColumns(
        {"semantic_score": F.coalesce("semantic_score", F.lit(0.0)), "lexical_score": T.lexical_score(F.col("text"), T.query_terms(query))}
    )
    own = ranking.hybrid_score(F.col("semantic_score"), F.col("lexical_score"))
    grown = ranking.expand_neighbors(hits, detailed, f.neighbor_window, own, bound=f.limit)
    return detailed.join(grown.drop("source_version_id", "ordinal"), "chunk_id")


def _near(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """The hits and the chunks up to ``window`` positions around them."""
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-window, window + 1)]))
    keys = hits.select("source_version_id", F.col("ordinal").alias("_o"), offsets.alias("_d")).select("source_version_id", (F.col("_o") + F.col("_d")).alias("ordinal")).distinct()
    return chunks.join(keys, ["source_version_id", "ordinal"], "left_semi")


def retrieval_event(query: str, filters: RetrievalFilters, hits: DataFrame, route: str | None = None) -> DataFrame:
    """One append-only event row: what was asked, in which scope, and what was selected.

    The id covers query, scope, time and selection, so repeated queries keep separate events.
    """
    f = filters.normalized()
    scope = F.lit(repr(sorted((k, str(v)) for k, v in vars(f).items())))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("ordinal").alias("o"), F.col("chunk_id").alias("c"))))
    row = hits.agg(entries.alias("e")).select(
        F.sha2(F.lit(query), 256).alias("query_hash"), scope.alias("filters"), F.col("e")["c"].alias("selected_chunks"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["c"].alias("k"), (-x["s"]).alias("v")))).alias("scores"),
        F.lit("lexical+semantic").alias("reranker"), F.lit(route).cast("string").alias("model_route"), F.current_timestamp().alias("created_at"),
    )
    key = F.concat_ws(":", F.lit(query), "filters", F.array_join("selected_chunks", ","), F.col("created_at").cast("string"))
    return row.select(F.sha2(key, 256).alias("event_id"), "*")


def candidates(chunks: DataFrame, sources: DataFrame, versions: DataFrame, artifacts: DataFrame, embeddings: DataFrame, filters: RetrievalFilters) -> DataFrame:
    """The five-way evidence join: chunk, source, version, artifact and (optional) vector."""
    f = filters.normalized()
    if not f.embedding_space_id:
        raise ValueError("candidate queries need an embedding space")
    vectors = embeddings.where(F.col("embedding_space_id") == f.embedding_space_id)
    return (
        chunks.where(compile_filters(f))
        .join(versions, "source_version_id")
        .join(sources, "source_id")
        .join(artifacts, "artifact_hash")
        .join(vectors, "chunk_id", "left")
    )


def unique_vector(embeddings: DataFrame) -> Column:
    """Aggregate that refuses to choose between the vectors of several spaces."""
    clash = F.raise_error(F.lit("embedding space must be explicit when a chunk has multiple vectors"))
    return F.when(F.count_distinct("embedding_space_id") > 1, clash).otherwise(F.first("vector"))
