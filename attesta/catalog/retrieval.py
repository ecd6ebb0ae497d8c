"""Lexical, vector and hybrid retrieval; neighbours, packages, context, benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.catalog import query
from attesta.catalog import sqlparts as S
from attesta.functions import text as T
from attesta.functions import vectors as V
from attesta.operators import filters as O
from attesta.operators import packaging, ranking
from attesta.operators.filters import RetrievalFilters
from attesta.plans import benchmark as B
from attesta.plans import retrieval as P
from attesta.session import cut_lineage
from attesta.sources import corpus

QUESTION = "the that/with onthe_eren Straße de la, tion"
_TERMS = T.query_terms(QUESTION)
_LEX = S.lexical("text", _TERMS)
_ACL = "acl_scope IN ('internal', 'public')"
SCOPE = RetrievalFilters(principal_acl_scopes=("internal", "public"), limit=10)


@query(
    "lexical_topk",
    f"WITH {S.DOCS} SELECT chunk_id, round(score, 8) AS score FROM (SELECT chunk_id, ordinal, {_LEX} AS score FROM docs WHERE {_ACL}) ORDER BY score DESC, ordinal, chunk_id LIMIT 10",
)
def lexical_topk(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir).where(O.compile_filters(SCOPE))
    scored = docs.select("chunk_id", "ordinal", T.lexical_score(F.col("text"), _TERMS).alias("score"))
    return ranking.top_k(scored, SCOPE.limit).select("chunk_id", F.round("score", 8).alias("score"))


def probe_vector(spark, sf_dir, vec_id=0):
    """The query vector: one row, fetched by key."""
    row = corpus.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query("vector_topk", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY round({_COS}, 6) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "embeddings")
    score = F.round(V.cosine_to(F.col("embedding"), probe_vector(spark, sf_dir)), 6)
    return rows.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(
    "vector_topk_by_space",
    f"""SELECT space_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY score DESC, vec_id) AS rank
 FROM (SELECT 'hash-' || label || ':64:v1' AS space_id, vec_id, round({_COS}, 6) AS score FROM embeddings)) WHERE rank <= 5""",
)
def vector_topk_by_space(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "embeddings")
    score = F.round(V.cosine_to(F.col("embedding"), probe_vector(spark, sf_dir)), 6)
    spaced = rows.select(corpus.text_of("hash-", F.col("label"), ":64:v1").alias("space_id"), "vec_id", score.alias("score"))
    return ranking.top_k_per(spaced, ["space_id"], 5, [F.desc("score"), F.asc("vec_id")])


@query(
    "l2_normalize",
    """SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared_norm, round(v[1], 6) AS first_value, round(v[64], 6) AS last_value
 FROM (SELECT vec_id, list_transform(e, lambda x: x / n) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings))""",
)
def l2_normalize(spark, sf_dir):
    unit = corpus.table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return unit.select("vec_id", F.round(squares, 6).alias("squared_norm"), F.round(F.col("v")[0], 6).alias("first_value"), F.round(F.col("v")[63], 6).alias("last_value"))


@query(
    "vector_literal",
    """SELECT vec_id, len(parsed)::BIGINT AS n, left(lit, 1) || right(lit, 1) AS brackets, round(list_sum(parsed), 6) AS total
 FROM (SELECT *, list_transform(string_split(trim(lit, '[]'), ','), lambda x: x::DOUBLE) AS parsed
   FROM (SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS lit FROM embeddings))""",
)
def vector_literal(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "embeddings").select("vec_id", V.to_literal(F.col("embedding")).alias("lit"))
    parsed = V.from_literal(F.col("lit"))
    return rows.select(
        "vec_id", F.size(parsed).cast("long").alias("n"), F.concat(F.left("lit", F.lit(1)), F.right("lit", F.lit(1))).alias("brackets"),
        F.round(F.aggregate(parsed, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(
    "hash_embedding",
    """SELECT doc_id, 256::BIGINT AS dimensions, n AS tokens, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared_norm
 FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_./:-]+'))::BIGINT AS n FROM documents)""",
)
def hash_embedding(spark, sf_dir):
    """Size and norm of every document's hashing embedding; a test compares the values, as SQL has no blake2b."""
    tokens = F.coalesce(F.size(T.embedding_tokens(F.col("text"))), F.lit(0)).cast("long")
    docs = corpus.documents(spark, sf_dir).select("doc_id", tokens.alias("tokens"), V.hash_embedding(F.col("text"), 256).alias("v"))
    return docs.select("doc_id", F.size("v").cast("long").alias("dimensions"), "tokens", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 4).alias("squared_norm"))


_HYBRID = f"""WITH {S.DOCS}, scored AS (SELECT chunk_id, ordinal, {_LEX} AS lexical, coalesce(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0) AS semantic
 FROM docs LEFT JOIN embeddings e ON e.vec_id = docs.doc_id WHERE {_ACL})"""


@query(
    "hybrid_topk",
    f"{_HYBRID} SELECT chunk_id, round(lexical, 6) AS lexical_score, round(semantic, 6) AS semantic_score, round(semantic * 0.75 + lexical * 0.25, 6) AS score FROM scored ORDER BY score DESC, ordinal, chunk_id LIMIT 10",
)
def hybrid_topk(spark, sf_dir):
    chunks = corpus.documents(spark, sf_dir)
    vectors = corpus.table(spark, sf_dir, "embeddings").select(corpus.text_of("doc-", F.col("vec_id")).alias("chunk_id"), "embedding")
    hits = P.hybrid_scores(chunks, vectors, QUESTION, probe_vector(spark, sf_dir), SCOPE, vector="embedding")
    rounded = hits.withColumns({c: F.round(c, 6) for c in ("lexical_score", "semantic_score", "score")})
    return ranking.top_k(rounded, SCOPE.limit).select("chunk_id", "lexical_score", "semantic_score", "score")


@query(
    "space_mismatch_rows",
    f"""WITH {S.DOCS} SELECT chunk_id FROM docs WHERE {_ACL} AND EXISTS (SELECT 1 FROM embeddings e WHERE 'doc-' || e.vec_id = chunk_id)
 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE 'doc-' || e.vec_id = chunk_id AND e.label = 2)""",
)
def space_mismatch_rows(spark, sf_dir):
    vectors = corpus.table(spark, sf_dir, "embeddings").select(
        corpus.text_of("doc-", F.col("vec_id")).alias("chunk_id"), corpus.text_of("hash-", F.col("label"), ":64:v1").alias("embedding_space_id")
    )
    chunks = corpus.documents(spark, sf_dir).where(O.compile_filters(SCOPE)).select("chunk_id")
    return P.space_mismatches(chunks, vectors, "hash-2:64:v1")


_TURN_Q = "the and tion"
_TURN_LEX = S.lexical("text", T.query_terms(_TURN_Q))
_TURN_HITS = f"""{S.TURNS}, scored AS (SELECT chunk_id, source_version_id, ordinal, {_TURN_LEX} AS score FROM turns),
 top AS (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal, chunk_id) AS rank FROM scored ORDER BY score DESC, ordinal, chunk_id LIMIT 8)"""


@query(
    "neighbor_expansion",
    f"""WITH {_TURN_HITS}, near AS (SELECT s.chunk_id, s.source_version_id, s.ordinal, greatest(0, s.score * 0.9) AS score, t.chunk_id AS via,
   row_number() OVER (PARTITION BY s.chunk_id ORDER BY t.rank, abs(s.ordinal - t.ordinal)) AS pick
   FROM top t JOIN scored s ON s.source_version_id = t.source_version_id AND abs(s.ordinal - t.ordinal) BETWEEN 1 AND 2 WHERE s.chunk_id NOT IN (SELECT chunk_id FROM top))
 SELECT chunk_id, source_version_id, ordinal, round(score, 8) AS score, via FROM near WHERE pick = 1
 UNION ALL SELECT chunk_id, source_version_id, ordinal, round(score, 8), '' FROM top""",
)
def neighbor_expansion(spark, sf_dir):
    turns = corpus.turns(spark, sf_dir)
    score = T.lexical_score(F.col("text"), T.query_terms(_TURN_Q))
    hits = P.ranked(ranking.top_k(turns.withColumn("score", score), 8))
    grown = ranking.expand_neighbors(hits, turns, 2, score, bound=8)
    return grown.select("chunk_id", "source_version_id", "ordinal", F.round("score", 8).alias("score"), F.array_join("neighboring_chunk_ids", ",").alias("via"))


@query(
    "dedupe_max_score",
    f"""WITH {S.TURNS}, two AS (SELECT chunk_id, {S.lexical('text', T.query_terms('the and'))} AS score FROM turns UNION ALL SELECT chunk_id, {S.lexical('text', T.query_terms('tion de la'))} FROM turns)
 SELECT chunk_id, round(max(score), 8) AS score FROM two GROUP BY chunk_id""",
)
def dedupe_max_score(spark, sf_dir):
    turns = corpus.turns(spark, sf_dir)
    runs = [turns.select("chunk_id", T.lexical_score(F.col("text"), T.query_terms(q)).alias("score")) for q in ("the and", "tion de la")]
    return ranking.best_per_chunk(runs[0].unionByName(runs[1])).select("chunk_id", F.round("score", 8).alias("score"))


@query(
    "context_compaction",
    rf"""WITH RECURSIVE {S.DOCS}, scored AS (SELECT domain_id, chunk_id, ordinal, {_LEX} AS score, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_./:-]+'))::BIGINT AS tokens FROM docs),
 r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY score DESC, ordinal, chunk_id) AS rank FROM scored) WHERE rank <= 20),
 walk AS (SELECT domain_id, rank, least(tokens, 1500) AS used, 1 AS n, TRUE AS taken, chunk_id, tokens FROM r WHERE rank = 1
  UNION ALL SELECT r.domain_id, r.rank, CASE WHEN t THEN w.used + least(r.tokens, 1500) ELSE w.used END, CASE WHEN t THEN w.n + 1 ELSE w.n END, t, r.chunk_id, r.tokens
  FROM walk w JOIN r ON r.domain_id = w.domain_id AND r.rank = w.rank + 1, LATERAL (SELECT w.n < 4 AND w.used < 1500 AND w.used + r.tokens <= 1500 AS t) x)
 SELECT domain_id, array_to_string(list(chunk_id ORDER BY rank), ',') AS chunk_ids, sum(tokens)::BIGINT AS tokens FROM walk WHERE taken GROUP BY domain_id""",
)
def context_compaction(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    scored = docs.select("domain_id", "chunk_id", "ordinal", T.lexical_score(F.col("text"), _TERMS).alias("score"), T.word_token_count(F.col("text")).alias("tokens"))
    context = P.context_per(ranking.top_k_per(scored, ["domain_id"], 20), ["domain_id"], 4, 1500)
    return context.select("domain_id", F.array_join("context.chunk_ids", ",").alias("chunk_ids"), F.col("context.tokens").alias("tokens"))


@query(
    "package_by_source",
    f"""WITH {S.TURNS}, hits AS (SELECT *, {_TURN_LEX} AS score FROM turns ORDER BY score DESC, ordinal, chunk_id LIMIT 40)
 SELECT source_version_id, 'pkg_' || left(sha256('pkg' || chr(0) || '{_TURN_Q}' || chr(0) || 'docs' || chr(0) || source_version_id || chr(0)), 24) AS package_id,
  round(max(score), 8) AS score, sum(greatest(1, (length(text) + 3) // 4))::BIGINT AS estimated_tokens, sum(strlen(text))::BIGINT AS estimated_bytes, count(*) AS n_refs,
  array_to_string(list('conv-' || conv_id || ':' || chunk_id ORDER BY score DESC, ordinal, chunk_id), ',') AS refs,
  arg_min(trim(string_split(text, chr(10))[1]), row(-score, ordinal, chunk_id)) AS statement FROM hits GROUP BY source_version_id""",
)
def package_by_source(spark, sf_dir):
    turns = corpus.turns(spark, sf_dir).withColumn("score", T.lexical_score(F.col("text"), T.query_terms(_TURN_Q)))
    hits = ranking.top_k(turns, 40).withColumns({"source_id": F.col("source_version_id"), "locator": F.col("chunk_id"), "chunk_hash": F.sha2("text", 256)})
    packs = packaging.package_hits(hits, _TURN_Q, "docs")
    refs = F.col("evidence_refs")
    return packs.select(
        "source_version_id", "package_id", F.round("score", 8).alias("score"), "estimated_tokens", "estimated_bytes", F.size(refs).cast("long").alias("n_refs"),
        F.array_join(refs["provenance_ref"], ",").alias("refs"), refs[0]["statement"].alias("statement"),
    )


_BENCH_T = S.terms("b.text")
_RANKED = f"""{S.DOCS}, scoped AS (SELECT chunk_id, source_id, ordinal, text, {S.terms('text')} AS terms FROM docs WHERE acl_scope IN ('internal', 'public')),
 asked AS (SELECT item_id, text AS passage, {S.terms('text')} AS terms FROM benchmark),
 scored AS (SELECT a.item_id, d.chunk_id, d.source_id, d.ordinal, len(list_intersect(a.terms, d.terms))::DOUBLE / len(a.terms) AS score, contains(d.text, a.passage) AS relevant,
   len(regexp_extract_all(d.text, '[\\p{{L}}\\p{{N}}_./:-]+'))::BIGINT AS tokens FROM asked a CROSS JOIN scoped d),
 ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ordinal, chunk_id) AS rank FROM scored) WHERE rank <= 5)"""


@query("bench_rank_lexical", f"WITH {_RANKED} SELECT item_id, rank, chunk_id, round(score, 8) AS score FROM ranked")
def bench_rank_lexical(spark, sf_dir):
    ranked = B.rank_lexical(B.scoped_documents(spark, sf_dir), B.benchmark_queries(spark, sf_dir), 5)
    return ranked.select(F.col("query_id").cast("long").alias("item_id"), "rank", "chunk_id", F.round("score", 8).alias("score"))


_METRICS = f"""{_RANKED}, rel AS (SELECT item_id, count(*) AS n_relevant FROM scored WHERE relevant GROUP BY item_id),
 firsts AS (SELECT item_id, min(CASE WHEN relevant THEN rank END) AS first_rank, count(*) AS returned FROM ranked GROUP BY item_id),
 per AS (SELECT f.item_id, CASE WHEN first_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS recall_at_k, coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE) AS mrr, returned
   FROM firsts f JOIN rel ON rel.item_id = f.item_id)"""


@query("bench_recall_mrr", f"WITH {_METRICS} SELECT item_id, recall_at_k, round(mrr, 6) AS mrr, returned FROM per")
def bench_recall_mrr(spark, sf_dir):
    return _metrics(spark, sf_dir).select(F.col("query_id").cast("long").alias("item_id"), "recall_at_k", F.round("mrr", 6).alias("mrr"), F.col("returned_chunks").alias("returned"))


def _metrics(spark, sf_dir):
    docs, queries = B.scoped_documents(spark, sf_dir), B.benchmark_queries(spark, sf_dir)
    ranked = B.rank_lexical(docs, queries, 5)
    return B.query_metrics(ranked, B.relevance(docs, queries), 5)


@query(
    "bench_summary",
    f"""WITH {_METRICS} SELECT 'lexical' AS mode, count(*) AS query_count, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr,
  round(median(returned), 3) AS median_returned, round(avg(returned), 3) AS mean_returned_chunks FROM per""",
)
def bench_summary(spark, sf_dir):
    summary = B.summarize(_metrics(spark, sf_dir).withColumn("mode", F.lit("lexical")))
    return summary.select("mode", "query_count", "recall_at_k", "mrr", "median_returned", "mean_returned_chunks")


_CENTROIDS = """parts AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 qv AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY label, i) GROUP BY label),
 scored AS (SELECT qv.label AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, qv)"""


def mean_vectors(rows):
    """Mean vector of every label; one row per (label, dimension) leaves the partial average."""
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("q"))


@query(
    "bench_rank_vector",
    f"WITH {_CENTROIDS} SELECT query_id::BIGINT AS query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5",
)
def bench_rank_vector(spark, sf_dir):
    """Every vector of the table against the mean vector of each label, in one pass."""
    rows = corpus.table(spark, sf_dir, "embeddings")
    means = mean_vectors(rows).withColumn("query_id", F.col("label").cast("string"))
    asked = (ranking.Query(r.query_id, vector=r.q) for block in ranking.query_blocks(means) for r in block)
    base = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("ordinal"), "embedding")
    ranked = ranking.rank_many(base, asked, 5, vector="embedding")
    return ranked.select(F.col("query_id").cast("long").alias("query_id"), F.col("ordinal").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


_HYBRID_BENCH = f"""{_CENTROIDS.split('scored AS')[0].rstrip().rstrip(',')}, {S.DOCS}, lab AS (SELECT list(label ORDER BY label) AS labels FROM qv),
 asked AS (SELECT item_id, {S.terms('b.text')} AS terms, (SELECT q FROM qv WHERE label = (SELECT labels[(b.item_id % len(labels) + 1)::INT] FROM lab)) AS q FROM benchmark b),
 cand AS (SELECT d.chunk_id, d.ordinal, {S.terms('d.text')} AS terms, e.embedding::DOUBLE[] AS v FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.acl_scope IN ('internal', 'public')),
 sc AS (SELECT item_id, chunk_id, ordinal, 0.75 * list_cosine_similarity(v, q) + 0.25 * (len(list_intersect(a.terms, c.terms))::DOUBLE / len(a.terms)) AS score FROM asked a CROSS JOIN cand c)"""


@query(
    "bench_rank_hybrid",
    f"WITH {_HYBRID_BENCH} SELECT item_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ordinal, chunk_id) AS rank FROM sc) WHERE rank <= 5",
)
def bench_rank_hybrid(spark, sf_dir):
    """Every embedded document against every benchmark text paired with a label's mean vector."""
    rows = corpus.table(spark, sf_dir, "embeddings")
    means = cut_lineage(mean_vectors(rows))
    numbers = means.select("q", (F.row_number().over(Window.orderBy("label")) - 1).alias("number"))
    of_query = F.pmod(F.col("query_id").cast("long"), F.lit(means.count())).cast("int").alias("number")
    queries = B.benchmark_queries(spark, sf_dir).select("query_id", "text", of_query).join(numbers, "number")
    asked = (ranking.Query(r.query_id, r.text, r.q) for block in ranking.query_blocks(queries) for r in block)
    vectors = rows.select(corpus.text_of("doc-", F.col("vec_id")).alias("chunk_id"), "embedding")
    embedded = B.scoped_documents(spark, sf_dir).join(vectors, "chunk_id")
    ranked = ranking.rank_many(embedded, asked, 5, text="text", vector="embedding")
    return ranked.select(F.col("query_id").cast("long").alias("item_id"), "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(
    "embedding_lookup",
    "SELECT doc_id, count(*) AS vectors, round(max(list_sum(embedding::DOUBLE[])), 5) AS total FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY doc_id",
)
def embedding_lookup(spark, sf_dir):
    """The only vector of each embedded document; several spaces would be an error."""
    vectors = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.lit("hash-64:64:v1").alias("embedding_space_id"))
    known = vectors.join(corpus.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    found = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"), P.unique_vector(known).alias("vector"))
    return found.select("doc_id", "vectors", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))
