"""Tokenising, line handling and lexical scoring as Column expressions.

Everything here stays in the JVM. Python and Java disagree on ``\\w`` (Unicode in Python,
ASCII in Java), so the token classes are spelled with Unicode categories.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token classes and separators of the retrieval contract.
LEXICAL_TOKEN = r"[\p{L}\p{N}_]+(?:[./:-][\p{L}\p{N}_]+)*"
LEXICAL_COMPONENT = r"[._/:+\-\n]+"
EMBEDDING_TOKEN = r"[A-Za-z0-9_./:-]+"
WORD_TOKEN = r"[\p{L}\p{N}_./:-]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SHARP_S = "ß"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def unicode_aware(pattern: str) -> str:
    """Let ``\\w``, ``\\b``, ``\\s`` and ``\\d`` of a Java pattern cover all of Unicode."""
    return "(?U)" + pattern


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(text, EDGE_SPACE, "")


@cache
def extra_foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose full case folding is more than lower-casing: to one character, to several.

    The sigmas are listed because lower-casing treats them by their place in the word.
    """
    pairs = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c.lower()} | {"Σ": "σ", "ς": "σ"}
    return {c: f for c, f in pairs.items() if len(f) == 1}, {c: f for c, f in pairs.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding; texts without any of the special characters are only lower-cased.

    A character that becomes several is one pass over the text, so only the sharp s is replaced
    in every special text, and the others where one of them is left.
    """
    single, several = extra_foldings()
    rare = {raw: plain for raw, plain in several.items() if raw != SHARP_S}

    def without_rare(common: Column) -> Column:
        replaced = common
        for raw, plain in rare.items():
            replaced = F.replace(replaced, F.lit(raw), F.lit(plain))
        return F.when(F.translate(common, "".join(rare), "") == common, common).otherwise(replaced)

    translated = F.translate(text, "".join(single), "".join(single.values()))
    folded = bound(F.replace(translated, F.lit(SHARP_S), F.lit(several[SHARP_S])), without_rare)
    # one table look-up a character; a class of some 300 characters would be tested one after the other
    ascii_only = F.octet_length(text) == F.char_length(text)
    plain = F.translate(text, "".join([*single, *several]), "") == text
    return F.lower(F.when(ascii_only, text).when(plain, text).otherwise(folded))


def splitlines(text: Column) -> Column:
    """Lines without terminators; a final terminator adds no empty line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def csv_cells(line: Column) -> Column:
    """Trimmed cells of one CSV line; a quoted cell may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'(\s*"(?:[^"]|"")*"\s*|[^,]*),'), F.lit(1))

    def bare(cell: Column) -> Column:
        return F.when(cell.rlike(r'^"(?:[^"]|"")*"$'), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.transform(F.transform(cells, strip), bare)


def first_line(text: Column) -> Column:
    return strip(F.split(text, LINE_BREAK, 2)[0])


def _term_list(text: Column) -> Column:
    """Whole tokens followed by identifier components, duplicates kept.

    The tokens are joined before folding so that the case mapping runs once per text instead
    of once per token.
    """
    joined = F.array_join(F.regexp_extract_all(text, F.lit(LEXICAL_TOKEN), F.lit(0)), "\n")
    parts = bound(bound(joined, casefold), lambda folded: F.concat(F.split(folded, "\n"), F.split(folded, LEXICAL_COMPONENT)))
    return F.array_remove(parts, "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexical_terms(text: Column) -> Column:
    return F.array_distinct(_term_list(text))


def query_terms(query: str) -> list[str]:
    """Terms of one query string, computed on the driver."""
    terms: dict[str, None] = {}
    for token in re.findall(r"\w+(?:[./:-]\w+)*", query):
        folded = token.casefold().lower()  # as the column form: foldings first, then lower case
        terms[folded] = None
        for part in re.split(r"[._/:+-]+", folded):
            if part:
                terms[part] = None
    return list(terms)


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("array()").cast("array<string>")


def lexical_score(text: Column, terms: Sequence[str]) -> Column:
    """Share of the query terms that occur in ``text``.

    The query is the build side of the intersection, so no set over the document's own
    vocabulary is ever built.
    """
    if not terms:
        return F.lit(0.0)
    shared = F.array_intersect(_term_list(text), literal_array(terms))
    return F.size(shared) / F.lit(float(len(terms)))


def embedding_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "[^\\x00-\\x7F]", " ")), F.lit(EMBEDDING_TOKEN), F.lit(0))


def word_token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0)))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.char_length(text) + 3) / 4)).cast("long")


def estimated_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def split_terms(value: str | None, pattern: str = r"[\s,;]+") -> list[str]:
    """Split a request value; the default separators are white space, comma and semicolon."""
    return [t for t in re.split(pattern, (value or "").strip()) if t.strip()]


def contains_all(haystack: Column, terms: Sequence[str]) -> Column:
    """True when every term is a substring of the (already lower-cased) haystack."""
    result = F.lit(True)
    for term in terms:
        result = result & F.contains(haystack, F.lit(term.lower()))
    return result


def term_score(haystack: Column, terms: Sequence[str]) -> Column:
    """Share of the terms that are substrings of the (already lower-cased) haystack."""
    if not terms:
        return F.lit(0.0)
    hits = [F.contains(haystack, F.lit(t.lower())).cast("int") for t in terms]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total / F.lit(float(len(terms)))


def chunk_locator(prefix: Column, ordinal: Column, line_start: Column, line_end: Column) -> Column:
    base = F.coalesce(prefix, F.lit("chunk"))
    start, end = line_start.cast("string"), line_end.cast("string")
    return (
        F.when(line_start.isNotNull() & line_end.isNotNull() & (line_start != line_end), F.concat(base, F.lit(":L"), start, F.lit("-L"), end))
        .when(line_start.isNotNull(), F.concat(base, F.lit(":L"), start))
        .otherwise(F.concat(base, F.lit("#chunk-"), (ordinal + 1).cast("string")))
    )
