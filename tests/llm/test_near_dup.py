import random
import re

import numpy as np
import pytest

from attesta.llm import near_dup
from attesta.llm.graph import components


def word_set(text, size):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, num, den):
    sets = [word_set(t, size) for _, t in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def variants(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 20, 60, 200]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((" " if rng.random() < 0.5 else "\n").join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size,num", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, odd_docs, size, num):
    docs = list(enumerate(variants(size, 40), 100)) + [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size, num, 100).drop("th").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((a, b, c, d == 1 or (a is None and c is None)) for a, b, c, d in brute(docs, size, num, 100)), key=str)


def test_keep_one(spark, odd_docs, no_docs):
    kept = near_dup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert near_dup.keep_one(no_docs).count() == 0
    copies = spark.createDataFrame([(i, "one two three four five six seven") for i in range(5)], "doc_id long, text string")
    assert [r["doc_id"] for r in near_dup.keep_one(copies).collect()] == [0]


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 4000).astype(np.uint64), rng.integers(0, 2**63, (2, 500)).astype(np.uint64)
    a, b = (near_dup.registers(np.concatenate([shared, x])).reshape(1, -1) for x in own)
    guess, n = near_dup.estimate(a, b)
    assert n[0] == near_dup.FUNCTIONS * near_dup.BUCKETS and abs(guess[0] - 0.8) < 0.1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert {labels[i] for i in range(41)} == {0} and labels[101] == 100
