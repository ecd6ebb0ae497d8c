"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Every benchmark item is cut into windows of 13 consecutive words (an item of fewer words is one
window). Containment of a window is exact, so one of its shingles is a sufficient prefix: the
rarest one in the corpus. Documents are probed with these anchor shingles only; a hit must leave
room for the window around it (position and length bounds) and is then compared word by word.

The benchmark is a query set. It is taken in blocks of ``block_chars`` characters, each block is
broadcast, and every block passes over all documents without a shuffle.

Defined results: null or empty texts have no words and no hits; items without words match
nothing; an item without id marks words but is not counted; equal items all count; document rows
are judged one by one, so repeated rows are fine; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import texts, with_arrow_columns

WINDOW = 13
SHINGLE = 3
BLOCK_CHARS = 4_000_000

# Words are runs of 0-9, a-z (after folding A-Z) and all bytes of non-ASCII characters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Block:
    """Windows of some items over a vocabulary of their words."""

    vocabulary: dict[bytes, int]
    windows: list[tuple[int, ...]]
    items: list[list[str]]  # per window, the ids of the items that hold it

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                held.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [item])
        return cls(vocabulary, list(held), [sorted(x) for x in held.values()])

    def shingles(self, size: int) -> list[tuple[int, ...]]:
        """All shingles of the windows; a window shorter than ``size`` is its own shingle."""
        return sorted({w[i : i + size] for w in self.windows for i in range(max(1, len(w) - size + 1))})


class Codes:
    """Finds shingles of any length up to ``size`` in arrays of word ids."""

    def __init__(self, shingles: list[tuple[int, ...]], base: int):
        self.by_length = {}
        for length in sorted({len(s) for s in shingles}):
            picked = [(self._code(np.array(s, dtype=np.int64)[:, None], base)[0], i) for i, s in enumerate(shingles) if len(s) == length]
            picked.sort()
            self.by_length[length] = (np.array([c for c, _ in picked], dtype=np.int64), np.array([i for _, i in picked], dtype=np.int64))
        self.base = base

    @staticmethod
    def _code(columns, base: int):
        code = columns[0]
        for column in columns[1:]:
            code = code * base + column
        return code

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and shingle numbers; ids are -1 for words outside the vocabulary."""
        at, which = [], []
        for length, (codes, numbers) in self.by_length.items():
            if len(ids) < length:
                continue
            known = np.ones(len(ids) - length + 1, dtype=bool)
            columns = [ids[i : len(ids) - length + 1 + i] for i in range(length)]
            for column in columns:
                known &= column >= 0
            places = np.flatnonzero(known)
            code = self._code([c[places] for c in columns], self.base)
            slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            found = codes[slot] == code
            at.append(places[found])
            which.append(numbers[slot[found]])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at), np.concatenate(which)


def _ids(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all documents of a batch, one -1 between documents; start and length of each."""
    get, parts, starts, lengths, at = vocabulary.get, [], [], [], 0
    gap = np.array([-1], dtype=np.int64)
    for text in texts(batch):
        words = words_of(text)
        parts += [np.array([get(w, -1) for w in words], dtype=np.int64), gap]
        starts.append(at)
        lengths.append(len(words))
        at += len(words) + 1
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(starts, np.int64), np.array(lengths, np.int64)


def shingle_counts(docs: DataFrame, block: Block, size: int) -> np.ndarray:
    """Occurrences of each shingle of the block in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, block.shingles(size)))

    def count(batches):
        vocabulary, shingles = shared.value
        codes, total = Codes(shingles, max(1, len(vocabulary))), np.zeros(len(shingles), np.int64)
        for batch in batches:
            _, which = codes.find(_ids(batch, vocabulary)[0])
            total += np.bincount(which, minlength=len(shingles))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(shared.value[1]), np.int64)
    for row in rows:  # at most one row for each shingle of the block
        counts[row["shingle"]] = row["n"]
    return counts


def _probe(docs: DataFrame, block: Block, size: int, counts: np.ndarray) -> DataFrame:
    """Extend the columns _spans and _items by what this block finds."""
    shingles = block.shingles(size)
    number = {s: i for i, s in enumerate(shingles)}
    anchors = []  # (shingle, offset in the window) by window
    for w in block.windows:
        options = [(int(counts[number[w[i : i + size]]]), i, number[w[i : i + size]]) for i in range(max(1, len(w) - size + 1))]
        anchors.append(min(options)[1:])
    used = sorted({s for _, s in anchors})
    place = {s: i for i, s in enumerate(used)}
    by_anchor: list[list[int]] = [[] for _ in used]
    for w, (_, s) in enumerate(anchors):
        by_anchor[place[s]].append(w)
    shared = docs.sparkSession.sparkContext.broadcast((block, [shingles[s] for s in used], by_anchor, [o for o, _ in anchors]))

    def make():
        block, used, by_anchor, offsets = shared.value
        codes = Codes(used, max(1, len(block.vocabulary)))
        first = np.concatenate([[0], np.cumsum([len(x) for x in by_anchor])]).astype(np.int64)
        flat = np.array([w for x in by_anchor for w in x], dtype=np.int64)
        offset = np.array(offsets, dtype=np.int64)
        length = np.array([len(w) for w in block.windows], dtype=np.int64)
        words = {n: np.array([w for w in block.windows if len(w) == n], dtype=np.int64) for n in set(length.tolist())}
        row_of = np.zeros(len(length), np.int64)
        for n in words:
            row_of[length == n] = np.arange(int((length == n).sum()))

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, starts, lengths = _ids(batch, block.vocabulary)
            at, which = codes.find(ids)
            many = first[which + 1] - first[which]
            at = np.repeat(at, many)
            begin = np.repeat(first[which], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            window = flat[begin]
            doc = np.searchsorted(starts, at, side="right") - 1
            start = at - offset[window]
            fits = (start >= starts[doc]) & (start + length[window] <= starts[doc] + lengths[doc]) if len(at) else np.zeros(0, bool)
            start, window, doc = start[fits], window[fits], doc[fits]
            equal = np.zeros(len(start), bool)
            for n, table in words.items():
                picked = np.flatnonzero(length[window] == n)
                for lot in range(0, len(picked), 65536):
                    some = picked[lot : lot + 65536]
                    equal[some] = (ids[start[some][:, None] + np.arange(n)] == table[row_of[window[some]]]).all(axis=1)
            start, window, doc = start[equal], window[equal], doc[equal]
            spans, items = batch.column(batch.schema.get_field_index("_spans")).to_pylist(), batch.column(batch.schema.get_field_index("_items")).to_pylist()
            for d in np.unique(doc):
                mine = doc == d
                new = [(int(s), int(s + n)) for s, n in zip(start[mine] - starts[d], length[window[mine]])]
                spans[d] = merged([(x["start"], x["end"]) for x in spans[d]] + new)
                items[d] = sorted({*items[d], *(i for w in np.unique(window[mine]) for i in block.items[w])})
            return [pa.array(spans, _PA_SPANS), pa.array(items, pa.list_(pa.string()))]

        return compute

    fields = [T.StructField("_spans", _SPANS), T.StructField("_items", T.ArrayType(T.StringType()))]
    return with_arrow_columns(docs, fields, make, keep=[c for c in docs.columns if c not in ("_spans", "_items")])


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def blocks(benchmark: DataFrame, block_chars: int, window: int):
    """The benchmark in blocks of about ``block_chars`` characters, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for k in range(n):
        yield Block.of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()], window)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``docs`` plus _spans (hit word ranges, disjoint) and _items (sorted item ids)."""
    out = docs.withColumns({"_spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "_items": F.array().cast("array<string>")})
    for block in blocks(benchmark, block_chars, window):
        if block.windows:
            out = _probe(out, block, shingle, shingle_counts(docs, block, shingle))
    return out


def n_words() -> Column:
    """Number of words of the column text."""
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def judged(marked: DataFrame, min_percent: int = 5) -> DataFrame:
    """Add n_words, n_hit, n_items and contaminated (at least ``min_percent`` of the words hit)."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return marked.withColumns({"n_words": n_words(), "n_hit": hit, "n_items": F.size("_items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Judgement of every document: doc_id, n_words, n_hit, n_items, items, spans, contaminated."""
    rows = judged(mark(docs.select("doc_id", "text"), benchmark, **options))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.col("_items").alias("items"), F.col("_spans").alias("spans"), "contaminated")
