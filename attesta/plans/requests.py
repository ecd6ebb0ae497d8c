"""Audit requests as a table: free text or JSON mappings, parsed in one plan.

A mapping may name a field by several keys; the first that holds something is taken. Lists come as
JSON arrays or as text with commas, semicolons or line breaks between the items. Keys that no field
has are returned. A value that is no JSON object is read as free text, with ``name: value``
mentions, as :meth:`attesta.plans.audit.AuditRequest.parse` does for one request.

Defined results: a null request is null in every field; null items and empty items of lists are left out; a number where a
list is expected is a list of one; a time that cannot be read is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import extract
from attesta.functions.text import bound

# The keys of each field, and the words of the text form.
KEYS = {
    "query": ("query", "request", "scope"),
    "scope": ("scope",),
    "systems": ("systems",),
    "components": ("components",),
    "since": ("start_time", "from"),
    "until": ("end_time", "to"),
    "symptoms": ("symptoms", "issues"),
    "outputs": ("requested_outputs", "outputs"),
    "correlation_ids": ("correlation_ids", "request_ids"),
    "source_types": ("source_types", "evidence_types"),
    "live_verification": ("require_live_verification", "live_verification_required"),
}
MENTIONS = {"scope": ("scope", "for", "about"), "systems": ("system", "systems"), "components": ("component", "components"), "symptoms": ("symptom", "symptoms", "failure", "error")}
OUTPUTS = ("timeline", "findings", "json", "human report", "verification")
SOURCE_TYPES = ("log", "code", "schema", "document", "query-output", "splunk-csv")
LIVE_WORDS = ("live verification", "on-prem", "database", "db")

def _no_items() -> Column:
    return F.array().cast("array<string>")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _holds_something(value: Column) -> Column:
    """Not null, not empty, not zero and not false."""
    text = value.cast("string")
    number = F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True))

    def of(kind: Column) -> Column:
        return (
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "BOOLEAN", text == "true")
            .when(kind == "STRING", text != "")
            .when(kind.startswith("ARRAY"), text != "[]")
            .when(kind.startswith("OBJECT"), text != "{}")
            .otherwise(number)
        )

    return F.coalesce(bound(_kind(value), of), F.lit(False))


def _field(mapping: Column, names: Sequence[str]) -> Column:
    each = [F.try_variant_get(mapping, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[bound(v, lambda x: F.when(_holds_something(x), x)) for v in each])


def _items(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[,\n;]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.coalesce(F.filter(parts, lambda x: x != ""), _no_items())


def _list(value: Column) -> Column:
    def of(v: Column) -> Column:
        array = F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x.isNotNull() & (x != ""))
        return F.when(_kind(v).startswith("ARRAY"), array).otherwise(_items(v.cast("string")))

    return F.coalesce(bound(value, of), _no_items())


def _mention(text: Column, lowered: Column, names: Sequence[str]) -> Column:
    """First line after the first of the names that is mentioned."""
    found = F.lit("")
    for name in reversed(names):
        at = F.instr(lowered, f"{name}:")
        rest = F.regexp_replace(F.substr(text, at + len(name) + 1), r"^\s+", "")
        line = F.regexp_replace(F.regexp_extract(rest, r"^[^\r\n]*", 0), r"\s+$", "")
        found = F.when(at > 0, line).otherwise(found)
    return found


def _said(lowered: Column, words: Sequence[str]) -> Column:
    """Those of the words that the text holds, with a blank in place of a hyphen as well."""
    each = [F.when(F.contains(lowered, F.lit(w)) | F.contains(lowered, F.lit(w.replace("-", " "))), F.lit(w)) for w in words]
    return F.array_compact(F.array(*each))


def _from_mapping(request: Column, mapping: Column) -> Column:
    value = {name: _field(mapping, keys) for name, keys in KEYS.items()}
    known = sorted({k for keys in KEYS.values() for k in keys})
    time = lambda v: extract.parse_utc(v.cast("string"))
    return F.struct(
        F.lit("mapping").alias("form"),
        F.coalesce(value["query"].cast("string"), F.lit("")).alias("query"),
        F.coalesce(value["scope"].cast("string"), F.lit("")).alias("scope"),
        *[_list(value[n]).alias(n) for n in ("systems", "components", "symptoms", "outputs", "correlation_ids", "source_types")],
        time(value["since"]).alias("since"),
        time(value["until"]).alias("until"),
        value["live_verification"].isNotNull().alias("live_verification"),
        F.coalesce(F.map_filter(F.from_json(request, "map<string,string>"), lambda k, _: ~k.isin(known)), F.create_map().cast("map<string,string>")).alias("unknown"),
    )


def _from_text(request: Column) -> Column:
    no_time = F.lit(None).cast("timestamp")

    def fields(text: Column, lowered: Column) -> Column:
        live = F.lit(False)
        for word in LIVE_WORDS:
            live = live | F.contains(lowered, F.lit(word))
        return F.struct(
            F.lit("text").alias("form"),
            text.alias("query"),
            _mention(text, lowered, MENTIONS["scope"]).alias("scope"),
            *[_items(_mention(text, lowered, MENTIONS[n])).alias(n) for n in ("systems", "components", "symptoms")],
            _said(lowered, OUTPUTS).alias("outputs"),
            F.regexp_extract_all(text, F.lit(extract.unicode_aware(extract.CORRELATION_ID)), F.lit(1)).alias("correlation_ids"),
            _said(lowered, SOURCE_TYPES).alias("source_types"),
            no_time.alias("since"),
            no_time.alias("until"),
            live.alias("live_verification"),
            F.create_map().cast("map<string,string>").alias("unknown"),
        )

    # the long text is stripped and lower-cased once, not once for each of the words looked for
    return bound(F.regexp_replace(request, r"^\s+|\s+$", ""), lambda text: bound(F.lower(text), lambda lowered: fields(text, lowered)))


def parse_requests(requests: DataFrame, column: str = "request") -> DataFrame:
    """All columns of ``requests`` plus ``parsed``, one struct of the fields of either form."""
    rows = requests.withColumn("_mapping", F.try_parse_json(F.col(column)))
    is_mapping = F.coalesce(_kind(F.col("_mapping")).startswith("OBJECT"), F.lit(False))
    parsed = F.when(is_mapping, _from_mapping(F.col(column), F.col("_mapping"))).otherwise(_from_text(F.col(column)))
    return rows.withColumn("parsed", F.when(F.col(column).isNotNull(), parsed)).drop("_mapping")


def search_terms(parsed: Column) -> Column:
    """The text a request searches for."""
    parts = F.concat(F.array(parsed["query"], parsed["scope"]), parsed["systems"], parsed["components"], parsed["symptoms"])
    joined = F.trim(F.array_join(F.filter(parts, lambda x: x != ""), " "))
    return F.when(joined == "", F.lit("failure audit")).otherwise(joined)
