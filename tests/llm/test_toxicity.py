import random

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import queries, toxicity
from attesta.llm.common import held_out

MASK = (1 << 64) - 1


def gram_hash(chars):
    """The hash of one n-gram of code points, step by step."""
    h = chars[0] * 0x9E3779B97F4A7C15 & MASK
    for c in chars[1:]:
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + c) & MASK
    return (h * 0x94D049BB133111EB & MASK) ^ len(chars)


def brute_score(text, table):
    """Greatest passage score by plain loops over words."""
    words, run = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            run += ch
        elif run:
            words.append(run)
            run = ""
    kept = [w for i, w in enumerate(words) if w not in words[max(0, i - 2) : i]]
    values = []
    for w in kept:
        marked = [0, *map(ord, w), 0]
        found = [int(table[gram_hash(marked[i : i + n]) >> (64 - toxicity.BITS)]) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        values.append(sum(found) // len(found))
    begins = sorted({min(i, max(0, len(values) - toxicity.PASSAGE)) for i in range(0, len(values), toxicity.PASSAGE // 2)})
    return max((sum(values[b : b + toxicity.PASSAGE]) / toxicity.PASSAGE for b in begins), default=0.0)


def test_scores_are_those_of_plain_loops(monkeypatch):
    rng = random.Random(1)
    table = np.random.default_rng(1).integers(-(10**6), 10**6, toxicity.SIZE)
    words = ["a", "is", "Straße", "İstanbul", "漢字", "x1", "the", "éte", "🙂", "ab-cd"] + ["".join(rng.choices("abcdé", k=rng.randint(1, 12))) for _ in range(60)]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)] + ["", " !", "same " * 100, "ab ba " * 60]
    got = toxicity.scored([toxicity.codes(t) for t in texts], table)
    assert got.tolist() == [brute_score(t, table) for t in texts]
    assert got.tolist() == [toxicity.scored([toxicity.codes(t)], table)[0] for t in texts]


def test_slices_only_cut_what_is_longer(monkeypatch):
    table = np.random.default_rng(2).integers(-(10**6), 10**6, toxicity.SIZE)
    monkeypatch.setattr(toxicity, "SLICE", 64)
    text = "word " * 12 + "    " + "more words of a text " * 9  # cuts fall between words or inside them
    assert len(toxicity.word_scores(toxicity.codes(text), table)[0]) >= len(text.split())
    assert toxicity.word_scores(toxicity.codes("x" * 200), table).shape == (3, 4)


def test_held_out_recall_and_clean_documents(spark):
    data = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op13_toxicity"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.7  # 329 toxic texts to learn from, in four languages
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.02


def test_unseen_misspellings_and_long_texts():
    rng = random.Random(3)
    plain = ["garden", "theory", "window", "letter", "of", "the", "and", "river", "paper", "green", "walks", "slowly"]

    def text(n, bad=()):
        words = rng.choices(plain, k=n) + list(bad)
        rng.shuffle(words)
        return " ".join(words)

    rows = [(text(rng.randint(5, 300), rng.choices(["idiot", "moron", "worthless"], k=rng.randint(1, 4))), 1) for _ in range(150)] + [(text(rng.randint(5, 300)), 0) for _ in range(150)]
    trainer = toxicity.Trainer(rows)
    trainer.train(10)
    model = trainer.model((1.0, 1.0))

    def p(t):
        return model.probability(toxicity.scored([toxicity.codes(t)], model.table)[0])

    assert p(text(20000, ["idiot", "moron"])) > 0.5 > p(text(20000))
    assert p(text(10, ["worthles"])) > 10 * p(text(10)) and p(text(10, ["idiott"])) > 10 * p(text(10))
    assert p("") < 0.5 and p(None or "") == p("!!!")


def test_odd_rows_labels_and_hot_ids(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (5, None), (6, 0), (7, 2)], "doc_id long, toxic int")
    hot = odd_docs.unionByName(odd_docs.where("doc_id = 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("i"))
    sample, sizes = toxicity.training_rows(hot, labels, "toxic", 100, 10**6)
    learned = [(r["doc_id"], r["label"]) for r in sample.collect()]
    assert len(learned) == len(set(learned)) and sum(sizes.values()) >= len(learned)  # one row of the hot id
    rows = toxicity.score(hot, toxicity.fit(hot, labels, epochs=2)).collect()
    assert len(rows) == hot.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values()) and by_text[None] == by_text[""] == by_text[" \n\t\n "]
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels.where("false"))).count() == 0
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.where("false"))).collect()} == {0.5}
    one = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.where("toxic = 0"))).collect()
    assert all(r["score"] < 0.01 for r in one)


def test_the_sample_is_bounded_by_rows_and_characters(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    sample, sizes = toxicity.training_rows(docs, labels, "toxic", 100, 10_000)
    assert sample.count() == 20 and sample.where(held_out(F.col("doc_id"))).count() == 0
    assert sum(sizes.values()) == labels.where(~held_out(F.col("doc_id"))).count()
    assert 60 <= toxicity.training_rows(docs, labels, "toxic", 100, 10**9)[0].count() <= 140
