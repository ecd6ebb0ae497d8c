import random

import numpy as np
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import joins, ranking
from attesta.plans.retrieval import ranked


def context(spark, tokens, **kw):
    rows = [(f"c{i}", t) for i, t in enumerate(tokens)]
    df = spark.createDataFrame([(rows,)], "r array<struct<chunk_id:string,tokens:long>>")
    return df.select(ranking.compact_context(F.col("r"), **kw).alias("c")).first().c


def test_context_compaction_skips_but_does_not_stop(spark):
    got = context(spark, [200, 100, 50, 6, 1])
    assert list(got.chunk_ids) == ["c0", "c2", "c3"] and got.tokens == 256
    assert list(context(spark, [900, 1]).chunk_ids) == ["c0"]
    assert list(context(spark, [1, 1, 1, 1, 1]).chunk_ids) == ["c0", "c1", "c2", "c3"]
    assert list(context(spark, []).chunk_ids) == []


def test_neighbours_belong_to_the_best_hit(spark):
    rows = [(f"v{v}#{o}", f"v{v}", o, "hit" if (v, o) in {(0, 2), (0, 4), (1, 0)} else "other") for v in range(2) for o in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_version_id string, ordinal long, text string")
    score = F.when(F.col("text") == "hit", 1.0 - F.col("ordinal") / 100).otherwise(F.lit(0.5))
    hits = ranked(ranking.top_k(chunks.withColumn("score", score), 3))
    got = {r.chunk_id: (round(r.score, 4), r.neighboring_chunk_ids) for r in ranking.expand_neighbors(hits, chunks, 1, score, bound=3).collect()}
    assert got == {
        "v1#0": (1.0, []), "v0#2": (0.98, []), "v0#4": (0.96, []), "v1#1": (0.45, ["v1#0"]), "v0#1": (0.45, ["v0#2"]), "v0#3": (0.45, ["v0#2"]), "v0#5": (0.45, ["v0#4"]),
    }
    assert ranking.expand_neighbors(hits, chunks, 0, score, bound=3).count() == 3


def test_numbering_is_exact_for_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", i * 3 + rng.randrange(3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, s long")
    got = ranking.numbered_within(df, ["k"], ["s"], F.expr("s div 100")).collect()
    expected = {}
    for k in {k for k, _ in rows}:
        for n, s in enumerate(sorted(s for kk, s in rows if kk == k), 1):
            expected[k, s] = n
    assert {(r.k, r.s): r.number for r in got} == expected


def corpus(spark, n=300, seed=11):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma_x", "delta.y", "straße", "the", "of"]
    rows = [(f"c{i:03d}", rng.randrange(4), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), [rng.gauss(0, 1) for _ in range(5)] if i % 7 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id string, ordinal long, text string, vector array<double>").repartition(7)


def brute(rows, queries, k, ws, wl):
    expected = {}
    for q in queries:
        terms = set(T.query_terms(q.text))
        qv = np.array(q.vector)
        scored = []
        for cid, ordinal, text, vec in rows:
            lexical = len(terms & set(T.query_terms(text))) / max(1, len(terms))
            v = np.array(vec) if vec is not None else None
            semantic = float(qv @ v / (np.linalg.norm(qv) * np.linalg.norm(v))) if v is not None and len(qv) else 0.0
            scored.append((-(ws * semantic + wl * lexical), ordinal, cid))
        expected[q.query_id] = [c for _, _, c in sorted(scored)[:k]]
    return expected


def got_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def test_batch_ranking_equals_brute_force(spark):
    rows, df = corpus(spark)
    rng = random.Random(2)
    queries = [ranking.Query(f"q{i}", t, [rng.gauss(0, 1) for _ in range(5)]) for i, t in enumerate(["alpha gamma", "delta y x", "none here", "the of the", "STRASSE beta"])]
    assert got_lists(ranking.rank_many(df, queries, 6, text="text")) == brute(rows, queries, 6, 0.0, 1.0)
    assert got_lists(ranking.rank_many(df, queries, 6, vector="vector")) == brute(rows, queries, 6, 1.0, 0.0)
    assert got_lists(ranking.rank_many(df, queries, 6, text="text", vector="vector")) == brute(rows, queries, 6, 0.75, 0.25)


def test_query_slices_give_the_same_result(spark, monkeypatch):
    rows, df = corpus(spark, 120)
    queries = [ranking.Query(f"q{i}", t, ()) for i, t in enumerate(["alpha", "beta of", "delta", "gamma_x the"])]
    whole = got_lists(ranking.rank_many(df, queries, 4, text="text"))
    monkeypatch.setattr(ranking, "QUERY_SLICE", 3)
    assert got_lists(ranking.rank_many(df, queries, 4, text="text")) == whole


def test_term_join_ranking_equals_brute_force(spark):
    rows, df = corpus(spark, 60)
    texts = {"a": "alpha gamma x", "b": "the of beta", "none": "absent words", "rare": "straße absent", "empty": ""}
    rows.append(("z-only", 0, "unique_term", None))
    df = df.unionByName(spark.createDataFrame(rows[-1:], df.schema))
    texts["one"] = "unique_term"
    queries = [ranking.Query(q, t, ()) for q, t in texts.items()]
    table = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    assert got_lists(ranking.rank_many_by_term(df, table, 5)) == brute(rows, queries, 5, 0.0, 1.0)
    assert got_lists(ranking.rank_many(df, queries, 5, text="text")) == brute(rows, queries, 5, 0.0, 1.0)


def test_postings_are_read_as_far_as_the_best_need_them(spark, monkeypatch):
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    rows = [(f"d{i:03}", i % 7, " ".join(rng.choices(common, k=20) + rng.choices(rare, k=6)), None) for i in range(400)]
    df = spark.createDataFrame(rows, "chunk_id string, ordinal long, text string, vector array<double>")
    texts = {f"q{i}": " ".join(rng.choices(common, k=rng.randint(0, 9)) + rng.choices(rare, k=rng.randint(0, 20))) for i in range(40)}
    texts |= {"whole": rows[17][2], "common": "c1 c2 c3", "none": "zzz"}
    table = spark.createDataFrame(list(texts.items()), "query_id string, text string").repartition(3)
    expected = brute(rows, [ranking.Query(q, t, ()) for q, t in texts.items()], 5, 0.0, 1.0)
    read = []
    score = ranking.score_candidates
    monkeypatch.setattr(ranking, "score_candidates", lambda *tables: read.append(tables[-1].collect()) or score(*tables))
    for first in (1, 4, 100):
        monkeypatch.setattr(ranking, "FIRST_TERMS", first)
        read.clear()
        assert got_lists(ranking.rank_many_by_term(df, table, 5)) == expected
        assert len({(r.query_id, r.id) for part in read for r in part}) == sum(map(len, read))  # nothing is read twice
        if first == 1:
            whole = {r.id for part in read for r in part if r.query_id == "whole"}
            assert len(whole) < len(set(T.query_terms(texts["whole"])))  # its frequent terms are never read
    assert {len(b) for b in ranking.query_blocks(table, 1000)} == {43} and sum(map(len, ranking.query_blocks(table, 5))) == 43


def test_relevance_slices_agree(spark, monkeypatch):
    from attesta.plans import benchmark

    chunks = spark.createDataFrame([("s1", "one two three"), ("s2", "two three four"), ("s3", None)], "source_id string, text string")
    queries = spark.createDataFrame([("a", "two three"), ("b", "four"), ("c", "zzz"), ("d", "two three")], "query_id string, text string")
    expected = {("a", "s1"), ("a", "s2"), ("b", "s2"), ("d", "s1"), ("d", "s2")}
    for block in (100, 2, 1):
        monkeypatch.setattr(benchmark, "SHORT_BLOCK", block)
        assert {(r.query_id, r.source_id) for r in benchmark.relevance(chunks, queries).collect()} == expected


def test_ranking_needs_no_cross_join_and_prunes_before_the_shuffle(spark):
    _, df = corpus(spark, 50)
    plan = ranking.rank_many(df, [ranking.Query("q", "alpha")], 5, text="text")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_frames_meet_code_by_suffix_in_both_directions(spark):
    frames = ["src/a.py", "a.py", "/srv/app/lib/util.js", "b\\c.java", "x.py"]
    code = ["repo/src/a.py:L1", "app/lib/util.js#chunk-1", "lib/data.py", "b/c.java", "nope.py", "ax.py"]
    norm = lambda p: p.replace("\\", "/").split(":")[0].split("#")[0]
    expected = {(f, c) for f in frames for c in code if norm(c).endswith(f.replace("\\", "/")) or f.replace("\\", "/").endswith(norm(c))}
    f = spark.createDataFrame([(x,) for x in frames], "path string")
    c = spark.createDataFrame([(x,) for x in code], "locator string")
    joined = joins.frames_to_code(f, c)
    assert {(r.path, r.locator) for r in joined.collect()} == expected and ("a.py", "lib/data.py") in expected
    assert "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, s int, v string")
    assert {r.k: r.v for r in ranking.latest_per_key(df, ["k"], ["s"]).collect()} == {"a": "y", "b": None}
    assert {r.k: r.v for r in ranking.first_per_key(df, ["k"], ["s"]).collect()} == {"a": "x", "b": None}


def test_frames_and_code_of_many_shapes(spark):
    heads, tails = ["", "a", "b/", "ab/", "/", "x/ab/", "\\"], ["c.py", "bc.py", "b/c.py", "ab/c.py", "c", "", "/", "é/c.py"]
    paths = sorted({h + t for h in heads for t in tails})
    norm = lambda p: p.replace("\\", "/")
    expected = {(f, c) for f in paths for c in paths if norm(f) and norm(c) and (norm(c).endswith(norm(f)) or norm(f).endswith(norm(c)))}
    f, c = (spark.createDataFrame([(p,) for p in paths], f"{name} string") for name in ("path", "locator"))
    assert {(r.path, r.locator) for r in joins.frames_to_code(f, c).collect()} == expected


def test_paths_are_merged_not_broadcast(spark):
    """Only the distinct lengths of bare names, one table for each direction, may go to every task."""
    f = spark.createDataFrame([("src/a.py",), ("a.py",), ("/srv/lib/util.js",)], "path string")
    c = spark.createDataFrame([("repo/src/a.py:L1",), ("lib/util.js",), ("util.js",)], "locator string")
    joined = joins.frames_to_code(f, c)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 2 and plan.count("SortMergeJoin") == 8
    assert {tuple(r) for r in joined.collect()} == {
        ("src/a.py", "repo/src/a.py:L1"), ("a.py", "repo/src/a.py:L1"), ("/srv/lib/util.js", "lib/util.js"), ("/srv/lib/util.js", "util.js"),
    }


def test_terms_of_a_chunk_are_made_once(spark, monkeypatch):
    _, df = corpus(spark, 20)
    table = spark.createDataFrame([("a", "alpha gamma")], "query_id string, text string")
    plans, cut = [], ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda part: plans.append(part._jdf.queryExecution().optimizedPlan().toString()) or cut(part))
    ranking.rank_many_by_term(df.select("chunk_id", "ordinal", "text"), table, 5)
    postings = next(p for p in plans if "ordinal" in p and "regexp_extract_all" in p)
    assert postings.count("regexp_extract_all") == 1
