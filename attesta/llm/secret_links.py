"""Secret scans with multipart credential linking.

Strong findings stand alone: assignments to a secret's name, access key identifiers, long hex
strings. Weak candidates (names of accounts, random-looking strings, addresses of services) are
everywhere in clean text, so they only count as parts of a credential: an interval join within the
scope looks for the complementary parts. An identifier needs a secret, a random string needs an
identifier or an endpoint, an endpoint needs both. The scope is a paragraph (up to an empty line),
and parts may be ``reach`` characters apart.

Positions are code points, ends exclusive. Defined results: a null text has no findings; weak
candidates that overlap a strong finding are part of it and not reported; repeated rows are
scanned alike; whole texts are scanned at any length; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attesta.llm.common import texts, with_arrow_columns

REACH = 300

# The strong patterns.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGNED = 8

_IDENTIFIER = re.compile(r"""(?i:(?:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
# starts only where a run of scheme characters starts, so that a long run is read once
_ENDPOINT = re.compile(r"""(?<![A-Za-z0-9+.-])[0-9+.-]*([A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+)""")
_BREAK = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

Span = tuple[str, int, int]


def strong_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Places:
    """Spans of some kinds, which may overlap; tells whether one lies within reach in the same scope."""

    def __init__(self, spans: list[Span], breaks: list[int]):
        self.spans = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in self.spans]
        self.furthest = list(accumulate((e for _, e in self.spans), max))  # the last end up to each span
        self.breaks = breaks

    def around(self, start: int, end: int, reach: int) -> Iterator[tuple[int, int]]:
        """The first span after, and all that start before ``end`` and are within reach."""
        at = bisect_left(self.starts, end)
        yield from self.spans[at : at + 1]
        for i in range(at - 1, -1, -1):
            if start - self.furthest[i] > reach:
                return
            yield self.spans[i]

    def near(self, start: int, end: int, reach: int) -> bool:
        for s, e in self.around(start, end, reach):
            gap = max(s - end, start - e)
            if gap <= reach and bisect_left(self.breaks, min(end, e)) == bisect_left(self.breaks, max(start, s)):
                return True
        return False

    def overlaps(self, start: int, end: int) -> bool:
        return any(s < end and start < e for s, e in self.around(start, end, 0))


def linked_spans(text: str, strong: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates whose complementary parts co-occur."""
    endpoints = [("endpoint", m.start(1), m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    names = [("identifier", m.start(), m.end()) for m in _IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    if not (strong or endpoints or names):
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    taken = Places(strong, breaks)
    names, endpoints, random = (
        [x for x in part if not taken.overlaps(x[1], x[2])]
        for part in (names, endpoints, [("random", m.start(), m.end()) for m in _RANDOM.finditer(text)])
    )
    inside = Places(endpoints + names, breaks)
    random = [x for x in random if not inside.overlaps(x[1], x[2])]
    identifiers = Places(names + [x for x in strong if x[0] == "access"], breaks)
    sites = Places(endpoints, breaks)
    secrets = Places(random + [x for x in strong if x[0] != "access"], breaks)
    return (
        [x for x in names if secrets.near(x[1], x[2], reach)]
        + [x for x in random if identifiers.near(x[1], x[2], reach) or sites.near(x[1], x[2], reach)]
        + [x for x in endpoints if identifiers.near(x[1], x[2], reach) and secrets.near(x[1], x[2], reach)]
    )


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All columns of ``docs`` plus strong and linked, arrays of (kind, start, end)."""

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            strong, linked = [], []
            for text in texts(batch):
                own = ordered(strong_spans(text)) if text else []
                strong.append([dict(zip(("kind", "start", "end"), x)) for x in own])
                linked.append([dict(zip(("kind", "start", "end"), x)) for x in ordered(linked_spans(text, own, reach))] if text else [])
            return [pa.array(strong, _PA_SPANS), pa.array(linked, _PA_SPANS)]

        return compute

    return with_arrow_columns(docs, [T.StructField("strong", _SPANS), T.StructField("linked", _SPANS)], make)
