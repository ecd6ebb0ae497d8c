"""Secret and private-endpoint redaction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from attesta.functions.text import unicode_aware

# What counts as sensitive, and the replacement.
MARK = "[redacted]"
CREDENTIAL = (
    r"(?i)\b(api[-_ ]?key|access[-_ ]?token|refresh[-_ ]?token|client[-_ ]?secret|"
    r"private[-_ ]?key|password|passwd|secret|token|credential)\b(\s*[:=]\s*)([^\s,\"']+)"
)
BEARER = r"(?i)\bAuthorization(\s*:\s*Bearer\s+)([^\s,\"']+)"
PRIVATE_ENDPOINT = (
    r"(?i)\bhttps?://(?:[^/\s:@]+(?::[^/\s:@]+)?@)?"
    r"(?:(?:localhost|127(?:\.\d{1,3}){3}|10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})"
    r"|(?:[A-Za-z0-9-]+\.)*(?:internal|local|corp|lan))(?::\d+)?(?:/[^\s\"']*)?"
)
PRIVATE_HOST_PREFIX = r"localhost|127\.|0\.0\.0\.0|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\."
PRIVATE_HOST_SUFFIX = r"\.(?:internal|local|corp|lan)"
SENSITIVE_KEYS = [
    "api_key", "apikey", "access_token", "refresh_token", "client_secret", "private_key", "password",
    "passwd", "secret", "token", "credential", "authorization", "endpoint", "uri", "url",
]

_SENSITIVE = re.compile("|".join(SENSITIVE_KEYS))


def redact_text(text: Column, secrets: Column | None = None) -> Column:
    """Blank known secret literals (longest first), credentials, bearer tokens, private endpoints."""
    redacted = text
    if secrets is not None:
        ordered = F.array_sort(
            F.filter(F.array_distinct(secrets), lambda s: s.isNotNull() & (s != "")),
            lambda a, b: F.char_length(b) - F.char_length(a),
        )
        redacted = F.when(F.size(ordered) > 0, F.aggregate(ordered, text, lambda acc, s: F.replace(acc, s, F.lit(MARK)))).otherwise(text)
    redacted = F.regexp_replace(redacted, unicode_aware(CREDENTIAL), "$1$2" + r"\[redacted\]")
    redacted = F.regexp_replace(redacted, unicode_aware(BEARER), "Authorization$1" + r"\[redacted\]")
    return F.regexp_replace(redacted, unicode_aware(PRIVATE_ENDPOINT), r"\[redacted\]")


def is_sensitive_key(key: Column) -> Column:
    return F.rlike(F.lower(key), F.lit("|".join(SENSITIVE_KEYS)))


_CONTAINER = r"^\s*[\[{]"


def redact_metadata(metadata: Column) -> Column:
    """Blank the values of sensitive keys in a MAP<STRING,STRING>, at any depth.

    Values that are JSON objects or lists are walked as trees; only maps that hold such a value
    leave the JVM.
    """
    flat = F.transform_values(metadata, lambda k, v: F.when(is_sensitive_key(k), F.lit(MARK)).otherwise(v))
    nested = F.exists(F.map_values(flat), lambda v: F.coalesce(v.rlike(_CONTAINER), F.lit(False)))
    return F.when(nested, F.from_json(redact_values(F.to_json(F.when(nested, flat))), "map<string,string>")).otherwise(flat)


@F.pandas_udf(StringType())
def redact_values(maps: pd.Series) -> pd.Series:
    """A JSON object of strings, with the JSON trees in its values redacted."""
    return maps.map(lambda m: None if m is None else json.dumps({k: redact_tree_text(v) for k, v in json.loads(m).items()}, ensure_ascii=False))


def redact_tree_text(value: str | None) -> str | None:
    if value is None or not re.match(_CONTAINER, value):
        return value
    try:
        return json.dumps(redact_tree(json.loads(value)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return value  # no JSON after all


def redact_tree(node: object) -> object:
    """The tree with the value of every sensitive key replaced."""
    if isinstance(node, dict):
        return {k: MARK if _SENSITIVE.search(k.lower()) else redact_tree(v) for k, v in node.items()}
    return [redact_tree(x) for x in node] if isinstance(node, list) else node


def secret_leaves(node: object) -> list[str]:
    """Strings below sensitive keys of a tree."""
    if isinstance(node, list):
        return [s for x in node for s in secret_leaves(x)]
    if not isinstance(node, dict):
        return []
    return [s for k, v in node.items() for s in (_strings(v) if _SENSITIVE.search(k.lower()) else secret_leaves(v))]


def _strings(node: object) -> list[str]:
    if isinstance(node, dict):
        return [s for v in node.values() for s in _strings(v)]
    return [s for v in node for s in _strings(v)] if isinstance(node, list) else [node] if isinstance(node, str) else []


@F.pandas_udf(ArrayType(StringType()))
def nested_secrets(maps: pd.Series) -> pd.Series:
    def leaves(value: str | None) -> list[str]:
        try:
            return secret_leaves(json.loads(value)) if value and re.match(_CONTAINER, value) else []
        except ValueError:
            return []

    return maps.map(lambda m: [] if m is None else [s for v in json.loads(m).values() for s in leaves(v)])


def sensitive_values(metadata: Column) -> Column:
    """The secret literals of a metadata map at any depth, for redacting them from text as well."""
    own = F.map_values(F.map_filter(metadata, lambda k, v: is_sensitive_key(k)))
    rest = F.map_filter(metadata, lambda k, v: ~is_sensitive_key(k) & F.coalesce(v.rlike(_CONTAINER), F.lit(False)))
    return F.array_distinct(F.when(F.size(rest) > 0, F.concat(own, nested_secrets(F.to_json(F.when(F.size(rest) > 0, rest))))).otherwise(own))


def is_private_endpoint(value: Column) -> Column:
    """Hosts of private networks, internal suffixes, or URLs that carry user information."""
    lowered = F.lower(value)
    authority = F.regexp_extract(lowered, r"^https?://([^/?#]*)", 1)
    host = F.regexp_extract(F.regexp_replace(authority, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    as_url = (
        (host == "")
        | F.rlike(host, F.lit("^(?:" + PRIVATE_HOST_PREFIX + ")"))
        | F.rlike(host, F.lit("(?:" + PRIVATE_HOST_SUFFIX + ")$"))
        | F.rlike(authority, F.lit(r"[^:@][^@]*@"))
    )
    as_text = F.rlike(lowered, F.lit("(?:" + PRIVATE_HOST_PREFIX + ")")) | F.rlike(lowered, F.lit("(?:" + PRIVATE_HOST_SUFFIX + ")$"))
    return F.when(F.rlike(lowered, F.lit("^https?://")), as_url).otherwise(as_text)
