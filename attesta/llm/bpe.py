"""Byte-level BPE as folds over byte arrays, with the ranks as literals.

A text is split by the tokenizer's pattern. A piece that is a token is that token; any other
piece starts as its bytes and is folded: each step merges the leftmost adjacent pair of lowest
rank, until no pair is a token. The ranks of pairs are a literal table in which the rows of all
left ids are laid over each other without collisions (`Ranks.placed`): two array accesses.

Interpreted folds cost about 0.2 ms a piece, far more than a corpus of mostly invented words may
take (figures in the README). So Spark folds the distinct pieces that fill most of the text: the
``cache_pieces`` most frequent ones of a bounded sample of documents. All other pieces get the
same merges in the Arrow tasks that look the pieces up, once per worker process and piece. The
sample decides what is folded where, never the ids.

Decoding maps every id to its bytes and concatenates them.

Defined results: a null text is the empty text (no ids); repeated rows are encoded alike; an
empty table gives an empty result; a document is one row throughout, of any length.
A lone surrogate can't occur in Spark strings; a single piece of n bytes costs n log n.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import hash_below, let, texts, with_arrow_columns

#: Documents sampled for the table of frequent pieces, its number of pieces and their length.
CACHE_DOCS = 6000
CACHE_PIECES = 65_536
CACHE_PIECE_CHARS = 48
#: Further pieces that a worker process remembers before it starts anew.
HELD_PIECES = 200_000

NO_RANK = 1 << 30


def java_pattern(pattern: str) -> str:
    r"""``\s`` and ``\S`` mean Unicode white space, as in the tokenizer's own matcher."""
    return "(?U)" + pattern


def array_literal(values: Iterable, kind: str) -> Column:
    """One literal array; the parser is folded away when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(list(values), separators=(",", ":"))), f"array<{kind}>")


class Ranks:
    """A vocabulary of ranked byte strings."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = pattern

    @cached_property
    def pairs(self) -> np.ndarray:
        """Rows (left id, right id, rank) of every pair of tokens whose bytes join to a token."""
        tokens = self.tokens
        rows = [(tokens[t[:i]], tokens[t[i:]], rank) for t, rank in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens]
        return np.array(rows, dtype=np.int64)

    @cached_property
    def placed(self) -> tuple[list[int], list[int], list[int]]:
        """The pairs as rows by left id, laid over each other without collisions.

        Returns shift by left id, and owner and rank by slot: the pair (l, r) has slot
        shift[l] + r, and it exists if the slot's owner is l.
        """
        pairs = self.pairs[np.argsort(self.pairs[:, 0], kind="stable")]
        n = len(self.bytes_of)
        bounds = np.searchsorted(pairs[:, 0], np.arange(n + 1))
        size = n + 4 * len(pairs)
        owner, rank, shift = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(n, np.int64)
        moves = np.random.default_rng(0)
        for left in sorted(range(n), key=lambda i: bounds[i] - bounds[i + 1]):  # long rows first, while most slots are free
            rights, ranks = pairs[bounds[left] : bounds[left + 1], 1], pairs[bounds[left] : bounds[left + 1], 2]
            if not len(rights):
                break
            move = 0
            while (owner[rights + move] >= 0).any():
                move = int(moves.integers(4 * len(pairs)))
            owner[rights + move], rank[rights + move], shift[left] = left, ranks, move
        end = int(np.flatnonzero(owner >= 0).max()) + 1 if len(pairs) else 0
        return shift.tolist(), owner[: max(end, 1)].tolist(), rank[: max(end, 1)].tolist()

    @cached_property
    def unreached(self) -> dict[str, int]:
        """Tokens that are whole pieces of text but that merging their bytes does not give."""
        rank_of = {(int(a), int(b)): int(c) for a, b, c in self.pairs}
        out = {}
        for token, rank in self.tokens.items():
            ids = [self.tokens[bytes([b])] for b in token]
            while len(ids) > 1:
                best, at = min((rank_of.get(p, NO_RANK), i) for i, p in enumerate(zip(ids, ids[1:])))
                if best == NO_RANK:
                    break
                ids[at : at + 2] = [best]
            if ids != [rank]:
                try:
                    out[token.decode("utf-8")] = rank
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole piece
        return out

    @cached_property
    def bytes_of(self) -> list[bytes]:
        out = [b""] * (max(self.tokens.values()) + 1)
        for token, rank in self.tokens.items():
            out[rank] = token
        return out


def fold_piece(piece: Column, ranks: Ranks) -> Column:
    """Token ids of one piece (a non-empty string) by ranked merges."""
    shift, owner, rank = (array_literal(x, "int") for x in ranks.placed)
    # each literal stands in the expression once, however often it is used
    return let(shift, lambda s: let(owner, lambda o: let(rank, lambda r: _fold(piece, ranks, s, o, r))))


def _fold(piece: Column, ranks: Ranks, shift: Column, owner: Column, rank_at: Column) -> Column:
    def rank(left: Column, right: Column) -> Column:
        slot = F.get(shift, left) + right
        return F.when(F.get(owner, slot) == left, F.get(rank_at, slot)).otherwise(F.lit(NO_RANK))

    single = array_literal([ranks.tokens[bytes([b])] for b in range(256)], "int")
    hexed = F.hex(F.encode(piece, "UTF-8"))
    length = F.length(hexed) / 2
    start = F.transform(F.sequence(F.lit(0), length.cast("int") - 1), lambda i: F.get(single, F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    def merge(state: Column) -> Column:
        ids, near = state["ids"], state["ranks"]

        def at(best: Column) -> Column:
            return let(F.array_position(near, best).cast("int"), lambda p: joined(best, p))

        def joined(best: Column, p: Column) -> Column:
            """Join the tokens at p and p + 1 (from 1) to ``best``; ranks p - 1 and p + 1 change."""
            before = F.when(p > 1, F.array(rank(F.get(ids, p - 2), best))).otherwise(F.array().cast("array<int>"))
            after = F.when(p + 1 < F.size(ids), F.array(rank(best, F.get(ids, p + 1)))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), p - 1), F.array(best), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
                F.concat(F.slice(near, F.lit(1), F.greatest(p - 2, F.lit(0))), before, after, F.slice(near, p + 2, F.size(ids))).alias("ranks"),
            )

        return let(F.array_min(near), lambda best: F.when(F.coalesce(best, F.lit(NO_RANK)) == NO_RANK, state).otherwise(at(best)))

    def folded(ids: Column) -> Column:
        first = F.struct(ids.alias("ids"), F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: rank(F.get(ids, i), F.get(ids, i + 1))).alias("ranks"))
        return F.when(F.size(ids) < 2, ids).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(ids)), first, lambda state, _: merge(state), lambda state: state["ids"]))

    return let(start, folded)


def encode_piece(piece: Column, ranks: Ranks) -> Column:
    """Token ids of one piece; a piece that is a token itself is that token."""
    folded = fold_piece(piece, ranks)
    for token, rank in sorted(ranks.unreached.items()):
        folded = F.when(piece == token, F.array(F.lit(rank))).otherwise(folded)
    return folded


def frequent_pieces(docs: DataFrame, ranks: Ranks, cache_docs: int, cache_pieces: int) -> dict[str, bytes]:
    """Ids of the most frequent distinct pieces of about ``cache_docs`` documents, by Spark's own fold.

    At most ``cache_pieces`` rows of at most ``CACHE_PIECE_CHARS`` characters reach the driver.
    """
    total = docs.count()
    sample = docs.where(hash_below(F.col("doc_id"), min(1.0, cache_docs / max(1, total)))).limit(2 * cache_docs)
    pieces = sample.select(F.explode(F.regexp_extract_all("text", F.lit(java_pattern(ranks.pattern)), F.lit(0))).alias("piece"))
    counted = pieces.where(F.length("piece") <= CACHE_PIECE_CHARS).groupBy("piece").count()
    top = counted.orderBy(F.desc("count"), "piece").limit(cache_pieces).repartition(docs.sparkSession.sparkContext.defaultParallelism, "piece")
    # the driver keeps the description of every plan: cut those that hold the literal tables
    conf = docs.sparkSession.conf
    length = conf.get("spark.sql.maxPlanStringLength")
    conf.set("spark.sql.maxPlanStringLength", "20000")
    try:
        found = top.select("piece", encode_piece(F.col("piece"), ranks).alias("ids")).toArrow()
    finally:
        conf.set("spark.sql.maxPlanStringLength", length)  # for the other plans of the session
    del ranks.pairs, ranks.placed
    ends = np.cumsum(pa.compute.list_value_length(found["ids"]).to_numpy())
    coded = np.concatenate([c.flatten().to_numpy() for c in found["ids"].chunks] or [np.empty(0)]).astype("<u4").tobytes()
    return {p.as_py(): coded[4 * a : 4 * b] for p, a, b in zip(found["piece"], [0, *ends], ends)}


class Pieces(dict):
    """piece -> ids as little-endian bytes; folds what it does not hold, and stays bounded."""

    def __init__(self, known: dict[str, bytes], tokens: dict[bytes, int]):
        super().__init__(known)
        self.known, self.tokens = known, tokens

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge_bytes(piece.encode("utf-8", "surrogatepass"), self.tokens), "<u4").tobytes()
        if len(self) > len(self.known) + HELD_PIECES:
            self.clear()
            self.update(self.known)
        if len(piece) <= CACHE_PIECE_CHARS:
            self[piece] = ids
        return ids


def merge_bytes(piece: bytes, tokens: dict[bytes, int]) -> list[int]:
    """The fold of ``fold_piece`` for one piece: a linked list and a heap, so long pieces cost n log n."""
    whole = tokens.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at i
    get = tokens.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, middle, stop = heappop(heap)
        if end[i] != middle or middle >= n or end[middle] != stop:
            continue  # one of the two tokens has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, stop, end[stop]))
        left = before[i]
        if left >= 0 and (r := get(piece[left:stop])) is not None:
            heappush(heap, (r, left, i, stop))
    out, i = [], 0
    while i < n:
        out.append(tokens[piece[i : end[i]]])
        i = end[i]
    return out


def encode(docs: DataFrame, ranks: Ranks, cache_docs: int = CACHE_DOCS, cache_pieces: int = CACHE_PIECES, back: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ids (array<int>).

    With ``back`` also what ``decode`` makes of the ids, in the same pass: a second one in the same
    stage would double the Python workers of an executor, and their tables.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent_pieces(docs, ranks, cache_docs, cache_pieces), ranks.tokens))
    pattern = ranks.pattern

    def make():
        find, pieces = regex.compile(pattern).findall, held_pieces(shared)
        bytes_of = {rank: token for token, rank in pieces.tokens.items()} if back else {}

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            coded = [b"".join([pieces[p] for p in find(text)]) if text else b"" for text in texts(batch)]
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            return [ids, *decoded_columns(ids, bytes_of.__getitem__)] if back else [ids]

        return compute

    return with_arrow_columns(docs, [T.StructField("ids", T.ArrayType(T.IntegerType())), *(DECODED if back else [])], make)


DECODED = [T.StructField("decoded", T.BinaryType()), T.StructField("packed", T.BinaryType())]


def decoded_columns(ids: pa.ListArray, piece: Callable[[int], bytes]) -> list[pa.Array]:
    """The joined bytes of each id list, and its ids as little-endian 32-bit integers."""
    flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    each = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
    return [pa.array([b"".join(map(piece, x.tolist())) for x in each], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())]


_HELD: dict[str, Pieces] = {}


def held_pieces(shared) -> Pieces:
    """One table for all tasks that a worker process runs with the same broadcast."""
    if shared._path not in _HELD:
        _HELD.clear()
        _HELD[shared._path] = Pieces(*shared.value)
    return _HELD[shared._path]


def decode(rows: DataFrame, ranks: Ranks) -> DataFrame:
    """All columns of ``rows`` plus decoded (the joined bytes of ids) and packed (ids as little-endian 32-bit)."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks.bytes_of)

    def make():
        piece = shared.value.__getitem__
        return lambda batch: decoded_columns(batch.column(batch.schema.get_field_index("ids")), piece)

    return with_arrow_columns(rows, DECODED, make)
