import math

import numpy as np
from pyspark.sql import functions as F

from attesta.functions import vectors as V


def test_cosine_rules(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([],), (None,), ([3.0, 4.0],)]
    df = spark.createDataFrame(rows, "v array<float>").select(V.cosine_to(F.col("v"), [2.0, 0.0]).alias("c"))
    assert [round(r.c, 9) for r in df.collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.6]


def test_pairwise_cosine_matches_batch_cosine(spark):
    rng = np.random.default_rng(3)
    data = [(rng.normal(size=8).tolist(),) for _ in range(20)]
    q = rng.normal(size=8).tolist()
    df = spark.createDataFrame(data, "v array<double>")
    both = df.select(V.cosine_to(F.col("v"), q).alias("a"), V.cosine_between(F.col("v"), F.array(*[F.lit(x) for x in q])).alias("b")).collect()
    assert all(math.isclose(r.a, r.b, abs_tol=1e-12) for r in both)


def test_hash_embedding_matches_driver_form_and_is_ascii(spark):
    text = "Order été Order.id x/y"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(V.hash_embedding(F.col("t"), 32).alias("v")).collect()
    assert np.allclose(got[0].v, V.hash_vector(text, 32), atol=1e-6)
    assert set(got[1].v) == {0.0}
    assert V.hash_vector("ORDER", 32) == V.hash_vector("order", 32)
    assert V.hash_vector("été", 32) == V.hash_vector("t", 32)


def test_vector_literal_round_trip(spark):
    df = spark.createDataFrame([([0.5, -1.25, 1e-9],)], "v array<double>").select(V.to_literal(F.col("v")).alias("l"))
    assert df.first().l == "[0.50000000,-1.25000000,0.00000000]"
    assert df.select(V.from_literal(F.col("l"))).first()[0] == [0.5, -1.25, 0.0]


def test_batch_limit():
    assert V.batch_limit(768, None) == 1
    assert V.batch_limit(768, 768 * 16 * 5) == 5


def test_hash_embedding_of_a_batch_with_nulls(spark):
    texts = ["a b a A", None, "", "été x", "one two three " * 50]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in rows.select("i", V.hash_embedding(F.col("t"), 16).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], V.hash_vector(t or "", 16), atol=1e-6)
