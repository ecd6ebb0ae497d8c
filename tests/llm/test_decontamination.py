import random
import re

import pytest

from attesta.llm import decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(13, len(p))
            windows = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if p else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} - {"None"}
        out.append((doc_id, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [10**9, 400])
@pytest.mark.parametrize("shingle", [1, 3])
def test_matches_brute_force(spark, odd_docs, block_chars, shingle):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("the of Und das é12 la LE word x y".split()) + rng.choice(["", ".", ","]) for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(20)] + [(None, text(16)), (3, text(14)), (99, None), (98, "the of"), (97, "the of")]
    docs = [(i, text(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + " " + text(9)) for i in range(60)]
    docs += [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars, shingle=shingle)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_sides(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.decontaminate(no_docs, benchmark).count() == 0
    assert decontamination.decontaminate(odd_docs, benchmark.where("false")).where("contaminated or n_hit > 0").count() == 0


def test_all_columns_pass_through(odd_docs, spark):
    benchmark = spark.createDataFrame([(1, "The same words stand here")], "item_id long, text string")
    marked = decontamination.mark(odd_docs, benchmark)
    assert marked.columns == odd_docs.columns + ["_spans", "_items"] and marked.count() == odd_docs.count()
