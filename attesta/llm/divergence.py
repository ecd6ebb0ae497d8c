"""Source divergence audit: how far the term frequencies of sources lie apart, by count-level bitmaps.

Each language keeps the terms that occur in at least ``MIN_DOCS`` of its documents. A kept term has
an id; the ids of similar frequent terms lie together, and 64 of them make a word. For each group
(language, source), word and count the ids with that count are a bitset of 64 bits; the terms that
a group lacks are the complement of its bitsets in the word. A joint cell of two groups, so many
terms with count a here and count b there, is the population count of the AND of two bitsets; it is
multiplied by the difference of the two smoothed frequencies, and cells add up over all words.
A word is the work of one step: at most 64 levels a group, so its rows don't grow with the corpus.

Counting is one pass over the texts. Tasks count by (language, source, term) in tables of bounded
size, so the shuffle gets at most one row for each term, group and table. What is dealt out by
(language, term) is totalled, filtered by document count and saved; no later step sees rare terms.

Defined results: null text, language or source are empty strings; every document row counts,
repeated ones and those without id as well; a language without kept terms gives its pairs of
groups with value 0 and no terms; a language with one group gives no pairs; ties are ranked by the
item's UTF-8 bytes; an empty table gives an empty result; whole texts are read; other columns are
not read. Terms are exact whatever their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.common import save

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING, UNIT = 5, 1_000_000_000
#: Distinct terms that a task holds before it hands its counts on.
HELD_TERMS = 400_000
#: Cells that are worked on at once, and pairs of groups whose sums a task holds.
TILE, HELD_PAIRS = 1 << 21, 1 << 22

#: Bytes that belong to terms, capitals of ASCII made small; all others separate.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def counted(docs: DataFrame, held_terms: int = HELD_TERMS) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents); a null term for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms, before = terms_of(text), len(n)
                n.update(terms)
                d.update(set(terms))
                size += len(n) - before
                if size > held_terms:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms)),
                    pa.array([source] * len(terms)),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(d[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "d"],
            )

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, total (of the language); a null term for every group."""
    # dealt out once by (lang, term): the sums by source and the totals over sources need no further shuffle
    each = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    all_ = each.withColumns({"docs": F.sum("d").over(of_term), "total": F.sum("n").over(of_term)})
    return all_.where((F.col("docs") >= min_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "total")


def smoothed(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)), exactly."""
    above = F.lit(UNIT).cast("decimal(11,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    below = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms and lang_total (of the language): one row a group."""
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.where("term is not null").groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    zero = F.lit(0).cast("long")
    return by_source.join(of_lang, "lang", "left").select("lang", "source", "total", F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_total", zero).alias("lang_total"))


def numbered(kept: DataFrame) -> DataFrame:
    """lang, term, id: unique within the language; terms of similar counts get ids of the same words.

    Ids are dense within a range partition and partitions start at multiples of 64, so numbering
    is no task of one row after the other over a language.
    """
    terms = kept.where("term is not null").groupBy("lang", "term").agg(F.first("total").alias("total"))
    dealt = terms.repartitionByRange("lang", F.desc("total"), "term").sortWithinPartitions("lang", F.desc("total"), "term")
    return dealt.select("lang", "term", F.monotonically_increasing_id().alias("id"))


def level_bitsets(kept: DataFrame, ids: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, word, source, n, bits: the terms of a word that the group has n times, 0 times included."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
    placed = kept.where("term is not null").join(ids, ["lang", "term"]).select("lang", "source", "n", F.shiftright("id", 6).alias("word"), bit.alias("bit"))
    levels = placed.groupBy("lang", "word", "source", "n").agg(F.bit_or("bit").alias("bits"))
    has = levels.groupBy("lang", "word", "source").agg(F.bit_or("bits").alias("has"))
    words = levels.groupBy("lang", "word").agg(F.bit_or("bits").alias("all"))
    every = words.join(groups.select("lang", "source"), "lang").join(has, ["lang", "word", "source"], "left")
    lacks = F.col("all").bitwiseAND(F.bitwise_not(F.coalesce("has", F.lit(0).cast("long"))))
    zeros = every.select("lang", "word", "source", F.lit(0).cast("long").alias("n"), lacks.alias("bits")).where("bits <> 0")
    return levels.unionByName(zeros)


def joint_sums(bits: np.ndarray, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of popcount(AND) * |difference of p| by pairs of groups; a group's rows begin at its start."""
    out = np.zeros((len(starts), len(starts)), np.int64)
    step = max(1, TILE // len(bits))
    for low in range(0, len(bits), step):
        high = min(low + step, len(bits))
        cells = np.bitwise_count(bits[low:high, None] & bits[None, :]).astype(np.int64)
        cells *= np.abs(p[low:high, None] - p[None, :])
        first = int(np.searchsorted(starts, low, side="right")) - 1
        last = int(np.searchsorted(starts, high, side="left"))
        rows = np.add.reduceat(cells, np.maximum(starts[first:last] - low, 0), axis=0)
        out[first:last] += np.add.reduceat(rows, starts, axis=1)
    return out


def pair_sums(levels: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b), value: the sum over all words of the joint cells times the difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, sources, sums = None, {}, np.zeros((0, 0), np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            names = np.array(list(sources), object)
            order = np.argsort([x.encode() for x in names]) if len(names) else np.zeros(0, int)
            ordered = sums[order][:, order]
            a, b = np.nonzero(np.triu(ordered, 1))
            for at in range(0, len(a), 100_000):
                i, j = a[at : at + 100_000], b[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array(names[order[i]]), pa.array(names[order[j]]), pa.array(ordered[i, j])], names=["lang", "a", "b", "value"])

        for key, source, p, bits in words(batches):
            if key[0] != lang:
                yield from out()
                lang, sources, sums = key[0], {}, np.zeros((0, 0), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
            place = np.array([sources.setdefault(s, len(sources)) for s in source[starts]])
            if len(sources) > len(sums):
                grown = np.zeros((2 * len(sources),) * 2, np.int64)
                grown[: len(sums), : len(sums)] = sums
                sums = grown
            sums[np.ix_(place, place)] += joint_sums(bits, p, starts)
            if len(sources) ** 2 > HELD_PAIRS:
                sums = sums[: len(sources), : len(sources)]
                yield from out()
                sources, sums = {}, np.zeros((0, 0), np.int64)
        sums = sums[: len(sources), : len(sources)]
        yield from out()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The rows of each (lang, word), also where they go over several batches."""
        held, key = [], None
        for batch in batches:
            lang, word, source = (np.array(batch.column(i).to_pylist(), object) for i in range(3))
            p, bits = batch.column(3).to_numpy(), batch.column(4).to_numpy().view(np.uint64)  # of a signed number, the absolute value's bits would be counted
            cuts = [0, *(np.flatnonzero((lang[1:] != lang[:-1]) | (word[1:] != word[:-1])) + 1), len(lang)]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                if (lang[i], word[i]) != key:
                    if held:
                        yield key, *(np.concatenate(x) for x in zip(*held))
                    held, key = [], (lang[i], word[i])
                held.append((source[i:j], p[i:j], bits[i:j]))
        if held:
            yield key, *(np.concatenate(x) for x in zip(*held))

    dealt = levels.select("lang", "word", "source", "p", "bits").repartition("lang", "word").sortWithinPartitions("lang", "word", "source")
    return dealt.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = save(kept_terms(docs, min_docs), "kept-terms")
    groups = save(group_totals(kept), "group-totals")
    ids = save(numbered(kept), "term-ids")
    p = smoothed(F.col("n"), F.col("total"), F.col("terms"))
    levels = level_bitsets(kept, ids, groups).join(groups, ["lang", "source"]).withColumn("p", p)
    sums = pair_sums(levels)
    both_ways = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both_ways, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    q = smoothed(F.col("whole"), F.col("lang_total"), F.col("terms"))
    above = kept.where("n > 0").withColumnRenamed("total", "whole").join(groups, ["lang", "source"]).withColumn("value", p - q).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top_terms))
