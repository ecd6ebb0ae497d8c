"""Cutting text into line blocks.

Greedy packing carries state from line to line, which no window frame expresses. The packing
of one text is independent of every other text, so it runs as an Arrow UDF on the text column
alone and the result is exploded in the JVM.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import ids
from attesta.functions.text import chunk_locator

# Block sizes of the two packing rules.
CHUNK_CHARS = 900
LINE_BLOCK_CHARS = 1200

#: Texts that one call of a packing function holds as Python objects; the Arrow batch around them is bounded by ``prepare``.
TEXTS_AT_ONCE = 64

BLOCK_TYPE = "array<struct<ordinal:int,text:string,line_start:int,line_end:int>>"
_ARROW_BLOCK = pa.list_(
    pa.struct([("ordinal", pa.int32()), ("text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
)


def block_spans(lines: list[str], limit: int, *, newline: int, overshoot: bool, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Half-open line ranges of the blocks of one text.

    Sizes come from prefix sums, so each block end is one binary search. A blank line closes a
    block and is swallowed by the cut. With ``overshoot`` the block takes lines until it has
    reached the limit; without it a line that would pass the limit starts the next block.
    """
    total = len(lines)
    prefix = [0, *accumulate(len(line) + newline for line in lines)]
    blanks = [i for i, line in enumerate(lines) if not line.strip()] + [total]
    start = 0
    while start < total:
        stop = blanks[bisect_right(blanks, start)] if start < blanks[-1] else total
        target = prefix[start] + limit
        end = bisect_left(prefix, target) if overshoot else bisect_right(prefix, target + newline) - 1
        end = min(max(end, start + 1), stop)
        yield start, end
        after = end + 1 if end == stop and end < total else end
        start = max(start + 1, after - overlap) if overlap and after > overlap else after


def text_blocks(text: str, limit: int, *, newline: int, overshoot: bool, overlap: int = 0, keep_whole: bool = False) -> list[dict]:
    lines = text.splitlines()
    found = []
    for start, end in block_spans(lines, limit, newline=newline, overshoot=overshoot, overlap=overlap):
        body = "\n".join(lines[start:end]).strip()
        if body:
            found.append({"ordinal": len(found), "text": body, "line_start": start + 1, "line_end": end})
    if keep_whole and not found and text.strip():
        found.append({"ordinal": 0, "text": text.strip(), "line_start": 1, "line_end": len(lines) or 1})
    return found


def _packed(texts: pa.Array, blocks_of: Callable[[str], list[dict]]) -> pa.Array:
    """The blocks of each text; few texts at a time are Python objects, the rest stays in Arrow."""
    parts = []
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        some = texts.slice(at, TEXTS_AT_ONCE).to_pylist()
        parts.append(pa.array([None if t is None else blocks_of(t) for t in some], type=_ARROW_BLOCK))
    return pa.concat_arrays(parts) if parts else pa.array([], type=_ARROW_BLOCK)


def chunk_blocks(text: Column, max_chars: int = CHUNK_CHARS, overlap: int = 0) -> Column:
    """Default chunking: blocks stay within ``max_chars`` unless one line alone is longer."""

    @F.arrow_udf(BLOCK_TYPE)
    def chunks(texts: pa.Array) -> pa.Array:
        return _packed(texts, lambda t: text_blocks(t, max_chars, newline=1, overshoot=False, overlap=overlap, keep_whole=True))

    return chunks(text)


def line_blocks(text: Column, max_chars: int = LINE_BLOCK_CHARS) -> Column:
    """File-parser blocks: a block absorbs lines until it has reached ``max_chars``."""

    @F.arrow_udf(BLOCK_TYPE)
    def blocks(texts: pa.Array) -> pa.Array:
        return _packed(texts, lambda t: text_blocks(t, max_chars, newline=0, overshoot=True))

    return blocks(text)


def explode_blocks(df: DataFrame, blocks: Column, keep: list[str]) -> DataFrame:
    """One row per block next to the ``keep`` columns of its source."""
    return df.select(*keep, F.inline(blocks))


def with_chunk_identity(df: DataFrame, uri: str = "source_uri") -> DataFrame:
    """Add ``chunk_id``, ``chunk_hash`` and ``locator`` to exploded blocks."""
    version, ordinal = F.col("source_version_id"), F.col("ordinal")
    return df.withColumns(
        {
            "chunk_id": ids.chunk_id(version, ordinal),
            "chunk_hash": ids.chunk_hash(version, ordinal, F.col("text")),
            "locator": chunk_locator(F.col(uri), ordinal, F.col("line_start"), F.col("line_end")),
        }
    )
