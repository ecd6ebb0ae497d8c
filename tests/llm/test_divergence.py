import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attesta.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    words = [TERM.findall(t.translate(SMALL)) for _, _, t in docs]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (lang, source, _), w in zip(docs, words):
        groups[lang].add(source)
        df[lang].update(set(w))
        counts[lang, source].update(w)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)

        def smooth(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: smooth(counts[lang, s]) for s in sources}
        q = smooth(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, part, x[2], -x[0], i) for part, found in (("pair", pairs), ("term", terms)) for i, x in enumerate(sorted(found), 1) if part == "pair" or i <= top}
    return out


def result(df):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


@pytest.mark.parametrize("held", [7, 100_000])
def test_against_brute_force(spark, monkeypatch, held):
    rng = random.Random(held)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "漢字", "ß"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"  # one source holds a third
        rows.append((rng.choice(["en", "en", "fr", None]), rng.choice([source, source, None]), ", ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))).title()))
    rows += [("xx", "a", "rare words only"), ("xx", "b", None), ("yy", "alone", "one two"), ("en", "no terms", "12 34"), ("en", "s1", "the " * 3000)]
    monkeypatch.setattr(divergence, "TILE", 50 if held == 7 else 1 << 21)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    kept = divergence.counted(df, held)
    assert sum(r["n"] for r in kept.collect()) == sum(len(TERM.findall(t or "")) for _, _, t in rows)
    got = result(divergence.audit(df, min_docs=5, top_terms=8))
    assert set(got) == brute(rows, 5, 8) and len(got) == len(set(got))
    assert ("xx", "a", "pair", "b", 0, 1) in got and not any(r[0] == "yy" for r in got)


def test_joint_sums_in_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    source = np.sort(rng.integers(0, 9, 70))
    starts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    bits, p = rng.integers(0, 2**63, 70).astype(np.uint64) * np.uint64(2), rng.integers(1, 1000, 70)
    want = np.zeros((len(starts),) * 2, np.int64)
    for i in range(70):
        for j in range(70):
            want[np.searchsorted(starts, i, "right") - 1, np.searchsorted(starts, j, "right") - 1] += int(bits[i] & bits[j]).bit_count() * abs(int(p[i]) - int(p[j]))
    for tile in (70, 200, 1000, 10**6):
        monkeypatch.setattr(divergence, "TILE", tile)
        assert (divergence.joint_sums(bits, p, starts) == want).all()


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    clashing = odd_docs.selectExpr("*", "'a' as term", "1 as n", "2 as total", "3 as id", "'b' as item", "4 as rank", "5 as word")
    assert set(result(divergence.audit(clashing, min_docs=2))) == brute(rows, 2, 50)
    assert result(divergence.audit(no_docs)) == []


def test_frequencies_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 1), (7, 11, 3), (9_007_199_254_740_993, 9_007_199_254_741_000, 2), (5_000_000_000_000_000, 9_100_000_000_000_000, 40_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long, total long, terms long").select(divergence.smoothed(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]
