"""Predicates that reject unsafe SQL, labels, references, paths and MIME types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import strip, unicode_aware

# Policy patterns and the suffix tables of the ingest contract.
WRITE_KEYWORDS = (
    r"(?i)\b(insert|update|delete|merge|create|alter|drop|truncate|grant|revoke|commit|rollback|execute|exec|call|"
    r"declare|begin|end|shutdown|replace|attach|detach|vacuum|analyze)\b"
)
SECOND_STATEMENT = r";\s*\S"
READ_PREFIX = r"(?i)^(SELECT|WITH|DESC)"
SAFE_LABEL = r"^[A-Za-z0-9._@:/+-]{1,128}$"
SAFE_REFERENCE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://|ref:)[^\s]{1,256}$"
PLACEHOLDER = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
FORBIDDEN_SECRET_KEYS = [
    "authentication_material_value", "credential_value", "password", "private_key",
    "private_key_pem", "raw_secret", "secret_value",
]
ARCHIVE_SUFFIXES = [".tar.gz", ".tgz", ".tar", ".zip", ".7z"]
CODE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go",
    ".java": "java", ".rb": "ruby", ".sh": "shell", ".ps1": "powershell",
}
MIME_TYPES = {
    ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json",
    ".yaml": "application/yaml", ".yml": "application/yaml", ".xml": "text/xml", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html",
    ".htm": "text/html", ".py": "text/x-python", ".js": "text/javascript", ".sh": "application/x-sh",
    ".eml": "message/rfc822", ".zip": "application/zip", ".tar": "application/x-tar",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
}
MIME_RULES = {
    ".csv": ("csv", "tab-separated-values"), ".tsv": ("csv", "tab-separated-values"), ".json": ("json",),
    ".yaml": ("yaml", "text"), ".yml": ("yaml", "text"), ".xml": ("xml", "text"),
}


def sql_rejection(sql: Column) -> Column:
    """NULL for an acceptable read-only statement, else the reason it is refused."""
    candidate = strip(sql)
    return (
        F.when(candidate.isNull() | (candidate == ""), F.lit("empty"))
        .when(F.rlike(candidate, F.lit(unicode_aware(SECOND_STATEMENT))), F.lit("multiple statements"))
        .when(F.rlike(candidate, F.lit(unicode_aware(WRITE_KEYWORDS))), F.lit("write-capable"))
        .when(~F.rlike(candidate, F.lit(READ_PREFIX)), F.lit("not read-only"))
    )


def is_safe_label(value: Column) -> Column:
    return F.coalesce(F.rlike(strip(value), F.lit(SAFE_LABEL)), F.lit(False))


def is_safe_reference(value: Column) -> Column:
    return F.coalesce(F.rlike(strip(value), F.lit(SAFE_REFERENCE)), F.lit(False))


def has_secret_keys(metadata: Column) -> Column:
    return F.arrays_overlap(F.map_keys(metadata), F.array(*[F.lit(k) for k in FORBIDDEN_SECRET_KEYS]))


def is_safe_path(name: Column) -> Column:
    """Relative, without parent references. Repeated or single-dot parts collapse and are fine."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    return ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")


def file_suffix(uri: Column) -> Column:
    """Lower-cased suffix; archive double suffixes stay whole."""
    lowered = F.lower(F.element_at(F.split(uri, "/"), -1))
    double = F.regexp_extract(lowered, r"(\.tar\.gz)$", 1)
    return F.when(double != "", double).otherwise(F.regexp_extract(lowered, r"^.+(\.[^.]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def is_archive(uri: Column) -> Column:
    return file_suffix(uri).isin(ARCHIVE_SUFFIXES)


def canonical_mime(uri: Column, declared: Column | None = None) -> Column:
    guessed = F.coalesce(_lookup(MIME_TYPES, file_suffix(uri)), F.lit("application/octet-stream"))
    return F.coalesce(F.nullif(declared, F.lit("")), guessed) if declared is not None else guessed


def mime_matches_suffix(mime: Column, suffix: Column) -> Column:
    ok = F.when(F.coalesce(mime, F.lit("")) == "", F.lit(True))
    for ext, markers in MIME_RULES.items():
        ok = ok.when(suffix == ext, F.rlike(mime, F.lit("|".join(re.escape(m) for m in markers))))
    return ok.otherwise(F.lit(True))


def classify(uri: Column) -> Column:
    """STRUCT<source_type, source_kind> chosen from the file suffix."""
    suffix = file_suffix(uri)
    pair = lambda t, k: F.struct(t.alias("source_type"), F.lit(k).alias("source_kind"))
    return (
        F.when(suffix == ".docx", pair(F.lit("document"), "document"))
        .when(suffix == ".pdf", pair(F.lit("pdf"), "document"))
        .when(suffix.isin(".csv", ".tsv"), pair(F.lit("csv"), "table"))
        .when(suffix.isin(".json", ".yaml", ".yml", ".xml"), pair(F.substring(suffix, F.lit(2), F.char_length(suffix)), "document"))
        .when(suffix == ".xlsx", pair(F.lit("schema"), "schema"))
        .when(suffix.isin(list(CODE_LANGUAGES)), pair(_lookup(CODE_LANGUAGES, suffix), "code"))
        .when(suffix.isin(".sql", ".ddl"), pair(F.lit("schema"), "schema"))
        .when(suffix == ".log", pair(F.lit("log"), "log"))
        .otherwise(pair(F.lit("document"), "document"))
    )


def looks_like_text(content: Column) -> Column:
    """No NUL and valid UTF-8 within the first 4096 bytes; a character may lie across the border."""
    sample = F.substring(content, 1, 4096)
    whole = F.is_valid_utf8(sample.cast("string"))
    for cut in (1, 2, 3):
        whole = whole | ((F.octet_length(content) > 4096) & F.is_valid_utf8(F.substring(content, 1, 4096 - cut).cast("string")))
    return whole & (F.position(F.lit("\0"), F.decode(sample, "ISO-8859-1")) == 0)


def sql_literal(value: object) -> str:
    """Render one template parameter."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"cannot render {type(value).__name__} as a SQL literal")


def render_template(sql: str, parameters: dict[str, object], allowed: tuple[str, ...] = ()) -> str:
    """Fill ``{{name}}`` placeholders; the parameter set must match exactly."""
    placeholders = set(re.findall(PLACEHOLDER, sql))
    declared = set(allowed) or placeholders
    for label, names in (
        ("undeclared", placeholders - declared), ("missing", declared - set(parameters)), ("unexpected", set(parameters) - declared)
    ):
        if names:
            raise ValueError(f"{label} template parameters: {sorted(names)}")
    rendered = re.sub(PLACEHOLDER, lambda m: sql_literal(parameters[m.group(1)]), sql)
    reason = rejection_reason(rendered)
    if reason:
        raise ValueError(f"template rejected: {reason}")
    return rendered


def rejection_reason(sql: str) -> str | None:
    """Driver-side form of :func:`sql_rejection` for a single statement."""
    candidate = sql.strip()
    if not candidate:
        return "empty"
    if re.search(SECOND_STATEMENT, candidate):
        return "multiple statements"
    if re.search(WRITE_KEYWORDS, candidate):
        return "write-capable"
    if not re.search(READ_PREFIX, candidate):
        return "not read-only"
    return None
