"""Grouped hybrid top-k: ranked on ids and numbers, fetched by key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.functions import text as T
from attesta.plans import retrieval as P
from attesta.plans import search_tools as ST
from attesta.operators.filters import RetrievalFilters

WORDS = ["alpha", "beta", "gamma_x", "of", "the", "delta"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    chunks = [(f"c{i:03}", i % 4, " ".join(rng.choices(WORDS, k=rng.randint(0, 8))), "hot" if i % 3 else f"t{i % 5}") for i in range(240)]
    vectors = [(c[0], [rng.gauss(0, 1) for _ in range(6)]) for c in chunks if rng.random() < 0.6]
    return chunks, vectors, spark.createDataFrame(chunks, "chunk_id string, ordinal long, text string, source_type string").repartition(4), spark.createDataFrame(vectors, "chunk_id string, vector array<double>")


def brute(chunks, vectors, query, q, k, grouped):
    terms, known, groups = set(T.query_terms(query)), dict(vectors), {}
    for cid, ordinal, text, kind in chunks:
        v = known.get(cid)
        semantic = float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))) if v else 0.0
        lexical = len(terms & set(T.query_terms(text))) / len(terms)
        groups.setdefault(kind if grouped else "", []).append((-(0.75 * semantic + 0.25 * lexical), ordinal, cid))
    return {g: [c for _, _, c in sorted(rows)[:k]] for g, rows in groups.items()}


@pytest.mark.parametrize("literal", [500, 3])
def test_equals_brute_force(spark, tables, monkeypatch, literal):
    chunks, vectors, df, emb = tables
    monkeypatch.setattr(P, "LITERAL_LOOKUP", literal)  # by literal ids, and by a join
    q = [0.3, -1.0, 0.2, 0.9, 0.0, 1.1]
    for keys in ([], ["source_type"]):
        got = {}
        for r in P.hybrid_best(df, "alpha gamma_x the", 7, keys, embeddings=emb, query_vector=q).orderBy("rank").collect():
            got.setdefault(r.source_type if keys else "", []).append(r.chunk_id)
            assert r.text is not None
        assert got == brute(chunks, vectors, "alpha gamma_x the", q, 7, bool(keys))
    only_text = P.hybrid_best(df, "alpha", 5)
    assert {r.semantic_score for r in only_text.collect()} == {0.0} and only_text.count() == 5
    assert P.hybrid_best(df.where("false"), "alpha", 5, ["source_type"], embeddings=emb, query_vector=q).count() == 0


def test_ranking_shuffles_no_text_and_reads_vectors(tables):
    _, _, df, emb = tables
    best = P.ranking.top_k_per(P.narrow_scores(df, "alpha", ["source_type"], embeddings=emb, query_vector=[1.0] * 6), ["source_type"], 5)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan
    assert set(best.columns) == {"chunk_id", "ordinal", "source_type", "lexical_score", "semantic_score", "score", "rank"}


def test_semantic_tools_use_vectors_and_others_do_not(spark, tables):
    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["docs_search"](spark, sf).collect()
    assert any(r.semantic_score > 0 for r in rows)
    from attesta.catalog import sqlparts as S
    from attesta.sources import corpus

    request = ST.SearchRequest("return", limit=3, filters=RetrievalFilters(principal_acl_scopes=("internal",)))
    exact = ST.search(corpus.evidence(spark, sf), "code_exact", request, corpus.document_vectors(spark, sf), S.QUERY_VECTOR)
    assert exact.where(F.col("semantic_score") != 0).count() == 0
