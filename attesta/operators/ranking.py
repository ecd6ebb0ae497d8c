"""Ranking: top-k, latest/first per key, neighbours, context compaction, batch ranking.

Skew rules used here: one row per key is a partial aggregate (``max_by``), k rows per key is
``row_number() <= k`` (Spark keeps only k rows per key and task before the shuffle), and a
full numbering within a possibly huge key goes through :func:`numbered_within`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.vectors import norms, rows_of
from attesta.session import cut_lineage

# Scoring weights, neighbour discount, context budget.
SEMANTIC_WEIGHT = 0.75
LEXICAL_WEIGHT = 0.25
NEIGHBOR_DISCOUNT = 0.9
CONTEXT_CHUNKS = 4
CONTEXT_TOKENS = 256

# Sizes above which the small side is no longer shipped to every task.
MAX_BROADCAST_ROWS = 100_000
QUERY_SLICE = 1_000


def rank_order(score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col("ordinal").asc(), F.col("chunk_id").asc()]


def top_k(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` rows; plans as TakeOrderedAndProject."""
    return df.orderBy(*rank_order(score)).limit(max(1, int(k)))


def top_k_per(df: DataFrame, keys: Sequence[str], k: int | Column, order: Sequence[Column] | None = None, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key with their 1-based rank."""
    window = Window.partitionBy(*keys).orderBy(*(order or rank_order()))
    return df.withColumn(rank, F.row_number().over(window).cast("long")).where(F.col(rank) <= k)


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: Callable[[Column, Column], Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last writer wins: the row with the greatest ``order`` per key, combined map-side."""
    return _one_per_key(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First writer wins: the row with the smallest ``order`` per key, combined map-side."""
    return _one_per_key(df, keys, order, F.min_by)


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, number: str = "number") -> DataFrame:
    """1-based position within ``keys`` by ``order`` without one task per key.

    ``bucket`` must not decrease along ``order`` (for example ``sequence div 65536``). Rows
    are numbered inside (keys, bucket) and shifted by the row count of the earlier buckets, so
    a key that owns a third of the table is spread over all of its buckets. Both sides
    are partitioned by (keys, bucket), so the shift joins in place.
    """
    parts = [*keys, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = bucketed.withColumn("_local", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    return local.join(shifts, parts).withColumn(number, F.col("_shift") + F.col("_local")).drop("_bucket", "_local", "_shift")


def expand_neighbors(hits: DataFrame, chunks: DataFrame, window: int, score: Column, bound: int) -> DataFrame:
    """Hits plus the chunks up to ``window`` positions away in the same source version.

    ``hits`` is a ranked top-k with ``rank, chunk_id, source_version_id, ordinal, score`` and at
    most ``bound`` rows, which bounds the probe keys by ``2 * window * bound``; they are
    broadcast only while that stays small. Ordinals are
    dense within a version, hence a position offset is an ordinal offset and the lookup is an
    equi-join. Neighbour scores (``score`` over chunk columns) are computed after that join,
    discounted, and never below zero. A neighbour belongs to the best hit that reaches it.
    """
    columns = ["chunk_id", "source_version_id", "ordinal", "score"]
    base = hits.select("rank", *columns)
    primary = base.select(*columns, F.array().cast("array<string>").alias("neighboring_chunk_ids"))
    if window <= 0:
        return primary
    offsets = F.explode(F.array(*[F.lit(o) for d in range(1, window + 1) for o in (-d, d)]))
    probes = base.select(
        F.col("rank").alias("_rank"), F.col("chunk_id").alias("_hit"), "source_version_id", F.col("ordinal").alias("_at"), offsets.alias("_offset")
    ).select("_rank", "_hit", "source_version_id", (F.col("_at") + F.col("_offset")).alias("ordinal"), F.abs("_offset").alias("_distance"))
    small = F.broadcast if 2 * window * bound <= MAX_BROADCAST_ROWS else lambda df: df
    found = chunks.join(small(probes), ["source_version_id", "ordinal"]).join(small(base.select("chunk_id")), "chunk_id", "left_anti")
    scored = found.select(*columns[:3], score.alias("score"), "_rank", "_hit", "_distance")
    owned = first_per_key(scored, ["chunk_id"], ["_rank", "_distance"])
    neighbors = owned.select(
        *columns[:3], F.greatest(F.lit(0.0), F.col("score") * NEIGHBOR_DISCOUNT).alias("score"), F.array("_hit").alias("neighboring_chunk_ids")
    )
    return primary.unionByName(neighbors)


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """One row per chunk, the higher score wins."""
    return latest_per_key(hits, ["chunk_id"], ["score"])


def compact_context(ranked: Column, max_chunks: int = CONTEXT_CHUNKS, max_tokens: int = CONTEXT_TOKENS) -> Column:
    """Chunks that fit the context budget, from a ranked ARRAY<STRUCT<chunk_id, tokens>>.

    The first chunk is always taken. A later one that would pass the token budget is skipped,
    not a stop, so this is a fold and not a running sum.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("picked"), F.array().cast("array<long>").alias("tokens"))

    def step(acc: Column, hit: Column) -> Column:
        tokens = hit["tokens"].cast("long")
        full = (F.size(acc["picked"]) >= max_chunks) | (acc["used"] >= max_tokens)
        over = (F.size(acc["picked"]) > 0) & (acc["used"] + tokens > max_tokens)
        skip = full | over | F.array_contains(acc["picked"], hit["chunk_id"])
        taken = F.struct(
            (acc["used"] + F.least(tokens, F.lit(max_tokens).cast("long"))).alias("used"),
            F.concat(acc["picked"], F.array(hit["chunk_id"])).alias("picked"),
            F.concat(acc["tokens"], F.array(tokens)).alias("tokens"),
        )
        return F.when(skip, acc).otherwise(taken)

    return F.aggregate(ranked, start, step, lambda acc: F.struct(acc["picked"].alias("chunk_ids"), F.aggregate(acc["tokens"], F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens")))


def hybrid_score(semantic: Column, lexical: Column, semantic_weight: float = SEMANTIC_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> Column:
    return semantic * F.lit(semantic_weight) + lexical * F.lit(lexical_weight)


@dataclass(frozen=True)
class Query:
    query_id: str
    text: str = ""
    vector: Sequence[float] = ()


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting: a larger table is left to the optimizer."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


RANK_SCHEMA = "query_id string, chunk_id string, ordinal long, lexical double, semantic double, score double"
_RANK_ARROW = pa.schema(
    [("query_id", pa.string()), ("chunk_id", pa.string()), ("ordinal", pa.int64()), ("lexical", pa.float64()), ("semantic", pa.float64()), ("score", pa.float64())]
)


class _QuerySet:
    """Queries in matrix form: term -> queries lists for lexical, unit rows for semantic."""

    def __init__(self, queries: Sequence[Query], use_text: bool, use_vector: bool) -> None:
        self.ids = [q.query_id for q in queries]
        terms = [T.query_terms(q.text) if use_text else [] for q in queries]
        self.vocabulary = sorted({t for ts in terms for t in ts})
        position = {t: i for i, t in enumerate(self.vocabulary)}
        owners: list[list[int]] = [[] for _ in self.vocabulary]
        for q, ts in enumerate(terms):
            for t in ts:
                owners[position[t]].append(q)
        self.counts = np.array([len(o) for o in owners], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if owners else np.zeros(0, np.int64)
        self.owners = np.array([q for o in owners for q in o], dtype=np.int64)
        self.sizes = np.array([max(1, len(ts)) for ts in terms], dtype=np.float64)
        self.vectors = None
        if use_vector:
            matrix = np.array([list(q.vector) for q in queries], dtype=np.float64)
            self.vectors = matrix / norms(matrix)[:, None]

    def lexical(self, terms: pa.ListArray) -> np.ndarray:
        """(row, query) share of query terms; repeated terms of a row count once."""
        total, width = len(terms), len(self.ids)
        slots = pc.index_in(terms.flatten(), value_set=pa.array(self.vocabulary, pa.string()))
        rows = np.repeat(np.arange(total), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        known = slots.is_valid().to_numpy(zero_copy_only=False)
        slot = slots.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        pairs = np.unique(rows[known] * max(1, len(self.vocabulary)) + slot)
        row, slot = np.divmod(pairs, max(1, len(self.vocabulary)))
        fan = self.counts[slot]
        first = np.cumsum(fan) - fan
        owner = self.owners[np.arange(fan.sum()) - np.repeat(first, fan) + np.repeat(self.starts[slot], fan)]
        shared = np.bincount(np.repeat(row, fan) * width + owner, minlength=total * width)
        return shared.reshape(total, width) / self.sizes

    def semantic(self, vectors: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(vectors), len(self.ids)))
        matrix, mask = rows_of(vectors, self.vectors.shape[1])
        out[mask] = (matrix / norms(matrix)[:, None]) @ self.vectors.T
        return out


Kept = list[tuple[float, int, str, float, float]]


class _BestPerQuery:
    """Running top-k of every query by (-score, ordinal, chunk)."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.kept: list[Kept] = [[] for _ in range(queries)]

    def add(self, chunk: np.ndarray, ordinal: np.ndarray, lexical: np.ndarray, semantic: np.ndarray, score: np.ndarray) -> None:
        rows, k = len(chunk), self.k
        # Ids are compared once per batch; afterwards the tie-break is an integer.
        tie = np.empty(rows, dtype=np.int64)
        tie[np.lexsort((chunk, ordinal))] = np.arange(rows)
        floor = np.partition(score, rows - k, axis=0)[rows - k] if rows > k else np.full(score.shape[1], -np.inf)
        top = score.max(axis=0)
        for q, best in enumerate(self.kept):
            if len(best) == k and top[q] < -best[-1][0]:
                continue
            column = score[:, q]
            at = np.nonzero(column >= floor[q])[0]
            at = at[np.lexsort((tie[at], -column[at]))[:k]]
            best += [(-column[i], int(ordinal[i]), str(chunk[i]), lexical[i, q], semantic[i, q]) for i in at]
            best.sort(key=lambda entry: entry[:3])
            del best[k:]


def rank_many(
    corpus: DataFrame,
    queries: Iterable[Query],
    k: int,
    *,
    text: str | None = None,
    vector: str | None = None,
    weights: tuple[float, float] = (SEMANTIC_WEIGHT, LEXICAL_WEIGHT),
) -> DataFrame:
    """Exact top-k of every query over the corpus in one pass.

    ``corpus`` has ``chunk_id, ordinal`` and the named text and/or vector column. The query set
    is bounded (slices of ``QUERY_SLICE``; :func:`rank_many_by_term` takes unbounded sets) and
    travels with the task closure. Each task scores its own rows and keeps k per query, so the
    shuffle carries at most k rows per query and task, never (query, chunk) pairs.
    """
    queries = list(queries)
    if not queries:
        return corpus.sparkSession.createDataFrame([], RANK_SCHEMA + ", rank long")
    semantic_weight, lexical_weight = (1.0, 0.0) if text is None else (0.0, 1.0) if vector is None else weights
    results = None
    for at in range(0, len(queries), QUERY_SLICE):
        part = _rank_slice(corpus, queries[at : at + QUERY_SLICE], k, text, vector, semantic_weight, lexical_weight)
        results = part if results is None else results.unionByName(part)
    return top_k_per(results, ["query_id"], k)


def _rank_slice(corpus: DataFrame, queries: list[Query], k: int, text: str | None, vector: str | None, ws: float, wl: float) -> DataFrame:
    asked = _QuerySet(queries, text is not None, vector is not None)
    columns = [F.col("chunk_id"), F.col("ordinal").cast("long").alias("ordinal")]
    if text is not None:
        columns.append(T._term_list(F.col(text)).alias("terms"))
    if vector is not None:
        columns.append(F.col(vector).alias("vector"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _BestPerQuery(len(asked.ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            zeros = np.zeros((batch.num_rows, len(asked.ids)))
            lexical = asked.lexical(batch.column("terms")) if text is not None else zeros
            semantic = asked.semantic(batch.column("vector")) if vector is not None else zeros
            ordinal = batch.column("ordinal").to_numpy(zero_copy_only=False)
            best.add(np.array(batch.column("chunk_id").to_pylist()), ordinal, lexical, semantic, ws * semantic + wl * lexical)
        rows = [(asked.ids[q], c, o, lex, sem, -s) for q, kept in enumerate(best.kept) for s, o, c, lex, sem in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), _RANK_ARROW)], schema=_RANK_ARROW)

    return corpus.select(*columns).mapInArrow(rank, RANK_SCHEMA)


#: Rarest terms of a query whose postings are read first; each later round reads four times as many.
FIRST_TERMS = 4


def rank_many_by_term(corpus: DataFrame, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Lexical top-k for a query table of any size (``query_id, text``): exact, rarest terms first.

    A query's terms are ordered by the number of chunks that hold them. The chunks of its first
    terms are candidates and are scored on their whole term sets. Once k candidates share ``m``
    terms or more, a chunk can only reach them if it shares ``m`` terms too, and then it holds one
    of the ``live - m + 1`` rarest; so later postings are not read. Rounds multiply the number of
    terms by four until every query has read that far. Frequent terms are read only by queries for which
    nothing rarer settles the order.

    A query with fewer than k matching chunks is filled with zero-score chunks in tie-break
    order; at most k - 1 of those can be matches already, so the first 2k - 1 chunks suffice.
    """
    terms = F.col("terms") if "terms" in corpus.columns else T.lexical_terms(F.col(text))
    chunks = corpus.select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"))
    # exploded where they are made: a filter on a column of terms would be pushed below it and make them three times
    held_terms = corpus.select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), F.explode(terms).alias("term"))
    asked_terms = queries.select("query_id", T.lexical_terms(F.col("text")).alias("terms"))
    vocabulary = cut_lineage(asked_terms.select(F.explode("terms").alias("term")).distinct().withColumn("id", F.monotonically_increasing_id()))
    wanted = asked_terms.select("query_id", F.size("terms").alias("size"), F.explode("terms").alias("term")).join(vocabulary, "term").drop("term")
    # texts go no further: from here on a term is a number, and terms that nobody asks for are gone
    postings = cut_lineage(held_terms.join(vocabulary, "term").drop("term"))
    held = cut_lineage(postings.groupBy("chunk_id", "ordinal").agg(F.collect_list("id").alias("ids")))
    asked = cut_lineage(wanted.groupBy("query_id", "size").agg(F.collect_list("id").alias("asked")))
    ordered = cut_lineage(rarest_first(postings, wanted))
    needed, scored, first, last = ordered.groupBy("query_id").agg(F.first("live").alias("needed")), None, 0, FIRST_TERMS
    while True:
        upto = F.least(F.col("needed"), F.lit(last))
        reading = ordered.join(needed, "query_id").where((F.col("position") > first) & (F.col("position") <= upto)).select("query_id", "id")
        if scored is not None and reading.isEmpty():
            break
        found = score_candidates(postings, held, asked, reading)
        found = found if scored is None else scored.unionByName(found).distinct()
        scored = cut_lineage(top_k_per(found, ["query_id"], k).drop("rank"))  # k rows of each query go on
        needed, first, last = reach(scored, ordered, k), last, 4 * last
    return top_k_per(filled(chunks, queries, scored, k), ["query_id"], k)


def rarest_first(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id, position, live) for the terms of a query that some chunk holds."""
    often = postings.groupBy("id").agg(F.count(F.lit(1)).alias("chunks"))
    of_query = Window.partitionBy("query_id")
    rows = wanted.join(often, "id").withColumn("position", F.row_number().over(of_query.orderBy("chunks", "id")))
    return rows.select("query_id", "id", "position", F.count(F.lit(1)).over(of_query).alias("live"))


def reach(scored: DataFrame, ordered: DataFrame, k: int) -> DataFrame:
    """(query_id, needed): the position up to which postings can still hold one of the best k chunks."""
    least = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("shared").alias("least"))
    live = ordered.groupBy("query_id").agg(F.first("live").alias("live"))
    enough = F.when(F.col("found") >= k, F.col("least")).otherwise(F.lit(1))
    return live.join(least, "query_id", "left").select("query_id", (F.col("live") - F.coalesce(enough, F.lit(1)) + 1).alias("needed"))


def score_candidates(postings: DataFrame, held: DataFrame, asked: DataFrame, reading: DataFrame) -> DataFrame:
    """(query_id, chunk_id, ordinal, shared, score) of the chunks that hold a term that is read now."""
    pairs = postings.join(reading, "id").select("query_id", "chunk_id").distinct()
    both = pairs.join(asked, "query_id").join(held, "chunk_id")
    return both.select("query_id", "chunk_id", "ordinal", F.size(F.array_intersect("asked", "ids")).alias("shared"), "size").withColumn("score", F.col("shared") / F.col("size")).drop("size")


def filled(chunks: DataFrame, queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """The scored rows, and zero-score chunks for queries with fewer than k of them."""
    matched = scored.select("query_id", "chunk_id", "ordinal", "score")
    first = chunks.select("chunk_id", "ordinal").orderBy("ordinal", "chunk_id").limit(2 * k - 1).collect()
    if not first:
        return matched
    spare = F.inline(F.array(*[F.struct(F.lit(r.chunk_id).alias("chunk_id"), F.lit(r.ordinal).cast("long").alias("ordinal"), F.lit(0.0).alias("score")) for r in first]))
    short = queries.select("query_id").join(matched.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    filler = short.select("query_id", spare).join(matched.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return matched.unionByName(filler)


def query_blocks(queries: DataFrame, size: int = QUERY_SLICE) -> Iterator[list]:
    """The rows of a query table (``query_id`` and more) in hash blocks of about ``size``, one at a time."""
    blocks = max(1, -(-queries.count() // size))
    for part in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part).collect()
        if rows:
            yield rows
