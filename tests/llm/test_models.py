import numpy as np
from pyspark.sql import functions as F

from attesta.llm import language, quality_model
from attesta.llm.common import held_out

DATA = "/root/testdata/sf0.01"


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.identify(docs, language.fit(docs)).where(held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_word_first_then_shorter_grams():
    model = language.build([("the", "en", 50), ("thing", "en", 9), ("der", "de", 50), ("dinge", "de", 9)])
    scorer = language.Scorer(model)
    assert scorer.predict("the THE der the")[0] == "en"
    assert scorer.predict("things")[0] == "en" and scorer.predict("ding")[0] == "de"
    assert scorer.predict("漢字")[1] == 0.5  # nothing known: all languages alike
    assert scorer.predict(None) == scorer.predict("12 !!") == ("und", 0.0)


def test_language_edge_rows(odd_docs, no_docs, spark):
    model = language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in rows)
    assert language.identify(no_docs.drop("score"), language.fit(no_docs)).count() == 0


def test_language_learns_from_the_shortest_where_all_are_long(spark):
    rows = [(1, "lang words " * 30, "xx"), (3, "other speech " * 50, "yy"), (4, "other speech " * 5000, "yy"), (5, "12", "zz"), (6, None, "zz")]
    model = language.fit(spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string"), sample_chars=400)
    assert model.languages == ["xx", "yy"]
    assert language.Scorer(model).predict("speech")[0] == "yy"


def test_quality_accuracy_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = quality_model.score(docs.select("doc_id", "text"), quality_model.fit(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = sum((r["score"] >= quality_model.THRESHOLD) == (r["quality"] == 1) for r in scored)
    assert right / len(scored) > 0.93


def test_quality_edge_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    weights = quality_model.fit(odd_docs, labels, epochs=1)
    rows = quality_model.score(odd_docs.drop("score"), weights).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.score(no_docs.drop("score"), quality_model.fit(no_docs, labels.where("false"))).count() == 0
    assert set(np.unique(quality_model.fit(odd_docs, labels.where("false")))) == {0.0}


def test_ftrl_learns_a_separable_set():
    features = quality_model.Features()
    rows = [(*features(t), y) for t, y in [("good words here", 1), ("BAD!! BAD!! BAD!!", 0)] * 30]
    z, n = np.zeros(quality_model.SIZE + 1), np.zeros(quality_model.SIZE + 1)
    quality_model.ftrl_pass(rows, z, n)
    w = quality_model.weights_of(z, n)
    good, bad = (quality_model.sigmoid(float(w[i] @ v)) for i, v in (features("good words here"), features("BAD!! BAD!!")))
    assert good > 0.8 > 0.4 > bad
