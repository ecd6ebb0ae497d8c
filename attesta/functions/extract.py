"""Structured facts pulled out of evidence text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import strip, unicode_aware

# The extraction patterns of the evidence contract.
CORRELATION_ID = r"(?i)(?:correlation[_-]?id|request[_-]?id|trace[_-]?id|session[_-]?id)\s*[:=]\s*([A-Za-z0-9._:-]+)"
TYPED_ID = r"(?i)\b(?:correlation|request|session)[-_ ]?id\b\s*[:=]\s*([A-Za-z0-9._:-]+)"
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
STACK_FRAME = r'(?:File\s+"([^"]+)",\s*line\s*(\d+)|([A-Za-z0-9_./\\-]+\.(?:py|java|cs|go|js|ts|rb|php|sql)):(\d+))'
ERROR_SIGNAL = r"(?i)\b(ERROR|FATAL|EXCEPTION|TRACEBACK|FAIL(?:ED|URE)?)\b"
ZERO_ROWS = r"(?i)\b0\s+rows?\b|\bno rows?\b"
SCHEMA_OBJECT = (
    r"(?i)\b(?:CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE)\s+"
    r"(?:TABLE|INDEX|VIEW|FUNCTION|PROC(?:EDURE)?)?\s*(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z0-9_.]+)"
)
CALL_LIKE = r"\b([A-Za-z0-9_]+)\s*\("
CALL_KEYWORDS = ["create", "alter", "drop", "select", "insert", "update", "delete"]
ENDPOINT = r"\b(?:https?://[^\s\"']+|/[A-Za-z0-9_./-]+|\b[A-Za-z0-9_.-]+#[A-Za-z0-9_.-]+)\b"
SECRET_SCAN = r"(?i)(?:BEGIN [A-Z ]+PRIVATE KEY|(?:api[_-]?key|password|secret|token)\s*[:=])"
PYTHON_CLASS = r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"
PYTHON_FUNCTION = r"(?m)^\s*(?:async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)"
SQL_OBJECT = (
    r"(?i)\b(?:create\s+(?:table|view|index)|alter\s+table|insert\s+into|update|from|join)\s+"
    r"([A-Za-z_][A-Za-z0-9_\.]*)"
)
MARKDOWN_HEADING = r"(?m)^(#{1,6})\s+(.+)$"
IDENTIFIER_QUERY = r"[A-Za-z_][A-Za-z0-9_.-]*"
LANGUAGES = {".py": "python", ".java": "java", ".sql": "sql", ".ps1": "powershell", ".psm1": "powershell"}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode_aware(pattern)), F.lit(group))


def correlation_ids(text: Column) -> Column:
    """Correlation, request, trace and session ids in order of first mention."""
    return F.array_distinct(_all(text, CORRELATION_ID))


def typed_ids(text: Column, kind: str, extra: Column | None = None) -> Column:
    """Sorted ids of one kind (correlation, request or session), merged with known ids.

    The kind is read off the whole mention, value included: "correlation" wins over
    "session", and everything else is a request id.
    """
    # One pass over the text; the value is read off each (short) mention.
    value = unicode_aware(TYPED_ID)
    mentions = F.transform(_all(text, TYPED_ID, 0), lambda m: F.struct(F.lower(m).alias("m"), F.regexp_extract(m, value, 1).alias("v")))

    def of_kind(x: Column) -> Column:
        correlation, session = F.contains(x["m"], F.lit("correlation")), F.contains(x["m"], F.lit("session"))
        return {"correlation": correlation, "session": ~correlation & session}.get(kind, ~correlation & ~session)

    found = F.transform(F.filter(mentions, of_kind), lambda x: x["v"])
    return F.array_sort(F.array_distinct(F.concat(found, extra) if extra is not None else found))


def parse_utc(value: Column) -> Column:
    """ISO-8601 text to TIMESTAMP in UTC; unparsable text becomes NULL."""
    return F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def timestamps(text: Column) -> Column:
    """All parsable timestamps, duplicates removed, in text order."""
    return F.array_distinct(F.filter(F.transform(_all(text, TIMESTAMP), parse_utc), lambda t: t.isNotNull()))


def event_time(text: Column, ingest_time: Column) -> Column:
    """First timestamp written in the text, else the ingest time."""
    return F.coalesce(F.get(timestamps(text), F.lit(0)), ingest_time)


def stack_frames(text: Column) -> Column:
    """ARRAY<STRUCT<raw, path, line>> for interpreter tracebacks and ``path.ext:line`` forms."""
    pattern = unicode_aware(STACK_FRAME)

    def shape(match: Column) -> Column:
        group = lambda n: F.regexp_extract(match, pattern, n)
        quoted = group(1) != ""
        path = F.when(quoted, group(1)).otherwise(group(3))
        line = F.when(quoted, group(2)).otherwise(group(4))
        return F.struct(F.concat(path, F.lit(":"), line).alias("raw"), path.alias("path"), line.alias("line"))

    return F.transform(_all(text, STACK_FRAME, 0), shape)


def has_error(text: Column) -> Column:
    return F.rlike(text, F.lit(unicode_aware(ERROR_SIGNAL)))


def has_zero_rows(text: Column) -> Column:
    return F.rlike(text, F.lit(unicode_aware(ZERO_ROWS)))


def has_secret(text: Column) -> Column:
    return F.rlike(text, F.lit(unicode_aware(SECRET_SCAN)))


def schema_objects(text: Column) -> Column:
    keywords = F.array(*[F.lit(k) for k in CALL_KEYWORDS])
    calls = F.filter(_all(text, CALL_LIKE), lambda name: ~F.array_contains(keywords, F.lower(name)))
    return F.array_distinct(F.concat(_all(text, SCHEMA_OBJECT), calls))


def endpoints(text: Column) -> Column:
    return F.array_distinct(_all(text, ENDPOINT, 0))


def file_name(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(uri, r"/+$", ""), "/"), -1)


def file_stem(uri: Column) -> Column:
    return F.regexp_replace(file_name(uri), r"^(.+)\.[^.]+$", "$1")


def language(uri: Column) -> Column:
    """Programming language by extension, NULL when the extension is not indexed."""
    extension = F.lower(F.regexp_extract(uri, r"(\.[^.]*)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension)


def symbol_names(text: Column, uri: Column) -> Column:
    """Sorted distinct names a reader could use to refer to this piece of evidence."""
    parts = F.filter(F.split(uri, "/"), lambda p: (p != "") & (p != "."))
    path_terms = F.concat(parts, F.array(file_name(uri), file_stem(uri)), F.when(F.startswith(uri, F.lit("/")), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")))
    lowered = F.lower(uri)
    declared = (
        F.when(F.endswith(lowered, F.lit(".py")), F.concat(_all(text, PYTHON_CLASS), _all(text, PYTHON_FUNCTION)))
        .when(F.endswith(lowered, F.lit(".sql")), _all(text, SQL_OBJECT))
        .otherwise(_all(text, MARKDOWN_HEADING, 2))
    )
    return F.array_sort(F.array_distinct(F.array_remove(F.concat(path_terms, declared), "")))


def query_table_rows(text: Column) -> Column:
    """Rows of a pipe-delimited result listing as ARRAY<MAP<STRING,STRING>>.

    Rule lines and rows whose width differs from the header are dropped; text whose first
    line has no pipe yields no rows.
    """
    from attesta.functions.text import splitlines

    lines = F.filter(F.transform(splitlines(text), strip), lambda ln: ln != "")
    cells = lambda ln: F.transform(F.split(ln, r"\|"), strip)
    header = cells(F.get(lines, F.lit(0)))
    body = F.filter(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda ln: ~F.startswith(ln, F.lit("-")) & (F.size(F.split(ln, r"\|")) == F.size(header)),
    )
    rows = F.transform(body, lambda ln: F.map_from_entries(F.arrays_zip(header.alias("k"), cells(ln).alias("v"))))
    empty = F.array().cast("array<map<string,string>>")
    return F.when((F.size(lines) > 0) & F.contains(F.get(lines, F.lit(0)), F.lit("|")), rows).otherwise(empty)
