r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text </turn>`` and a line break. A text may be raw (``:``) or
escaped (``!`` in place of the colon); a raw text holds neither ``###`` nor ``</turn>``. Every
rendered turn is parsed again by a deterministic parser and compared with its source; on any
difference the next form is tried. In the escaped form a backslash stands before another one and
before ``h`` (for ``###``) or ``e`` (for ``</turn>``), so no control string is left and the form
always reads back.

Rendering works row by row. Reading back goes through each conversation in order, one turn at a
time: a digest of a conversation depends on all its turns in sequence, so a conversation is one
ordered stream of one task, but never held in memory.

The loss mask covers exactly the texts of assistant turns, escapes included.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role
and text, so repeated rows are repeated turns; rows without conv_id form one conversation; an
empty table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import with_arrow_columns

OPEN, CLOSE = "### ", " </turn>\n"
_CONTROL = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e"}
_PLAIN = {"\\": "\\", "h": "###", "e": "</turn>"}
_ESCAPE, _UNESCAPE = re.compile(r"\\|###|</turn>"), re.compile(r"\\([\\he])")
_ROLE_ESCAPE, _ROLE_UNESCAPE = re.compile(r"[\\:!\n#]"), re.compile(r"\\x([0-9a-f]{2})")
_HEADER = re.compile(r"### ((?:[^\\:!\n#]|\\x[0-9a-f]{2})*)([:!]) ")
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _CONTROL[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[1]], text)


def render(role: str, text: str, escaped: bool) -> str:
    name = _ROLE_ESCAPE.sub(lambda m: f"\\x{ord(m[0]):02x}", role)
    return f"{OPEN}{name}{'!' if escaped else ':'} {escape(text) if escaped else text}{CLOSE}"


class Malformed(ValueError):
    pass


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the rendered text) of every turn; deterministic, one pass."""
    at = 0
    while at < len(formatted):
        header = _HEADER.match(formatted, at)
        if not header:
            raise Malformed(f"no turn starts at {at}")
        start = header.end()
        end = formatted.find("</turn>", start)
        if end <= start - 1 or formatted[end - 1 : end + len(CLOSE) - 1] != CLOSE:
            raise Malformed(f"the turn at {at} does not end")
        body = formatted[start : end - 1]
        if "###" in body:
            raise Malformed(f"the turn at {at} holds a control string")
        role = _ROLE_UNESCAPE.sub(lambda m: chr(int(m[1], 16)), header[1])
        yield role, unescape(body) if header[2] == "!" else body, start, end - 1
        at = end - 1 + len(CLOSE)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn that reads back as its source, and where its text lies in it."""
    for escaped in (False, True):
        rendered = render(role, text, escaped)
        try:
            turns = list(parse(rendered))
        except Malformed:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2], turns[0][3]
    raise AssertionError("an escaped turn always reads back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start, loss_end (null for turns that are not learned)."""
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [format_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            learned = [r == LEARNED_ROLE for r in batch.column(2).to_pylist()]
            return [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] if k else None for r, k in zip(rows, learned)], pa.int64()),
                pa.array([r[2] if k else None for r, k in zip(rows, learned)], pa.int64()),
            ]

        return compute

    return with_arrow_columns(clean, [T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())], make)


READ_BACK = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ]
)


class Reader:
    """Reads one conversation from its formatted turns alone."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, loss_start: int | None, loss_end: int | None) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss_start is not None:
            masked = formatted[loss_start:loss_end]
            plain = unescape(masked) if formatted[loss_start - 2] == "!" else masked
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, computed from the formatted turns and the loss mask only."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = None, []
        for batch in batches:
            for conv_id, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = Reader(conv_id)
                reader.feed(text, start, end)
            if rows:
                yield packed(rows)
                rows = []
        if reader is not None:
            yield packed([reader.row()])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=READ_BACK.names)

    return ordered.mapInArrow(read, READ_BACK)
