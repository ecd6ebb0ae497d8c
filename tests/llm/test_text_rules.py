import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_match_brute_force(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "a b c d e f g h " * 3), (-2, "a " * 30), (-3, "l one\nl one\n\nl one\n"), (-4, "a b c d e f g h i a b c d e f g h")], "doc_id long, text string")
    docs = docs.union(more).union(odd_docs.select("doc_id", "text")).withColumn("n", F.monotonically_increasing_id())
    texts = [r["text"] for r in docs.orderBy("n").collect()]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in quality_rules.quality_rules(docs).collect())
    assert got == Counter(brute(t) for t in texts)


def test_verdict(spark, no_docs):
    clean = "The reader of this text is in the house and it is warm there for the people who came with the morning train from the city."
    junk = " | ".join(f"word{i}" for i in range(40))
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame([(1, clean), (2, junk), (3, "a b c d e f g h " * 9), (4, None)], "doc_id long, text string")).collect()}
    assert rows[1]["kept"] and not rows[2]["kept"] and not rows[2]["base_failed"] and rows[3]["base_failed"] and rows[4]["base_failed"]
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_projection_only(odd_docs):
    plan = quality_rules.quality_rules(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("low,high,kept", [(0, 10, True), (11, None, False), (None, 3, False)])
def test_rule_bounds(spark, low, high, kept):
    df = spark.createDataFrame([(5.0,)], "m double")
    assert df.select(quality_rules.verdict((quality_rules.Rule("m", low, high),)).alias("k")).first()["k"] is kept
