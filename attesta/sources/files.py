"""File ingestion: scan, archive and mail expansion, parsing, quarantine.

``binaryFile`` gives one row per file, so Spark splits the work by file. Archives and mails
turn one row into many through ``mapInArrow``; parsing is an Arrow UDF on (name, content).
Bad files never fail the job: they leave through the ``error`` column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import guards, ids
from attesta.sources import parsers

FILE_COLUMNS = ["source_uri", "content", "size_bytes", "modified_at"]
PARTS_SCHEMA = "source_uri string, content binary, size_bytes long, modified_at timestamp, parent_uri string, part string, error string"


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file below ``path`` as ``source_uri, content, size_bytes, modified_at``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _shape(reader.load(path))


def stream_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Streaming form of :func:`scan_files`; each file is delivered once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _shape(reader.load(path))


def _shape(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("source_uri"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")
    )


def expand_containers(files: DataFrame) -> DataFrame:
    """Replace archives by their members and mails by body and attachments."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("source_uri", pa.string()), ("content", pa.binary()), ("size_bytes", pa.int64()),
                ("modified_at", pa.timestamp("us", tz="UTC")), ("parent_uri", pa.string()), ("part", pa.string()), ("error", pa.string()),
            ]
        )
        for batch in batches:
            for row in batch.to_pylist():
                parts = []
                try:
                    parts = list(_parts_of(row["source_uri"], row["content"]))
                except Exception as error:  # noqa: BLE001 - any malformed file is quarantined
                    parts = [(row["source_uri"], row["content"], None, "failed", str(error)[:240])]
                for uri, data, parent, part, error in parts:
                    yield pa.RecordBatch.from_pylist(
                        [{"source_uri": uri, "content": data, "size_bytes": len(data), "modified_at": row["modified_at"], "parent_uri": parent, "part": part, "error": error}],
                        schema=schema,
                    )

    return files.mapInArrow(expand, PARTS_SCHEMA)


def _parts_of(uri: str, data: bytes) -> Iterator[tuple[str, bytes, str | None, str, str | None]]:
    if len(data) > parsers.MAX_FILE_BYTES:
        raise ValueError("evidence file exceeds size limit")
    lowered = uri.lower()
    if lowered.endswith((".zip", ".tar", ".tgz", ".tar.gz", ".7z")):
        for name, member in parsers.archive_members(uri, data):
            yield f"{uri}/{name}", member, uri, "member", None
    elif lowered.endswith(".eml"):
        _, body, attachments = parsers.mail_parts(data)
        if body is not None:
            yield f"{uri}#body", body.encode("utf-8"), uri, "email-body", None
        for name, attachment in attachments:
            yield f"{uri}/attachments/{name}", attachment, uri, "email-attachment", None
    else:
        yield uri, data, None, "file", None


def parse_blocks(uri: Column, content: Column) -> Column:
    """STRUCT<blocks, error> for one file."""

    @F.arrow_udf(f"struct<blocks:{parsers.BLOCK_SCHEMA},error:string>")
    def parse(uris: pa.Array, contents: pa.Array) -> pa.Array:
        blocks, errors = [], []
        for name, data in zip(uris.to_pylist(), contents.to_pylist()):
            try:
                blocks.append(parsers.parse_file(name.rsplit("/", 1)[-1], data))
                errors.append(None)
            except Exception as error:  # noqa: BLE001 - any malformed file is quarantined
                blocks.append([])
                errors.append(str(error)[:240])
        return pa.StructArray.from_arrays([pa.array(blocks, parsers.ARROW_BLOCKS), pa.array(errors, pa.string())], ["blocks", "error"])

    return parse(uri, content)


def ingestion_jobs(files: DataFrame, channel: str) -> DataFrame:
    """One content-addressed job per expanded file, with its classification.

    ``files`` carries the columns of :func:`scan_files`.
    """
    parts = expand_containers(files)
    uri = F.col("source_uri")
    kind = guards.classify(uri)
    email_key = F.concat(F.col("parent_uri"), F.lit(":"), F.when(F.col("part") == "email-body", F.lit("body")).otherwise(F.regexp_extract(uri, r"/attachments/(.*)$", 1)))
    is_mail = F.startswith(F.col("part"), F.lit("email-"))
    hashed = parts.withColumns(
        {
            "source_id": F.when(is_mail, ids.ingest_source_id(F.lit("mail-drop"), email_key)).otherwise(ids.ingest_source_id(F.lit(channel), uri)),
            "content_hash": F.sha2(F.col("content"), 256),
            "channel": F.lit(channel),
            "mime_type": F.when(F.col("part") == "email-body", F.lit("text/plain")).otherwise(guards.canonical_mime(uri)),
            "source_type": F.when(F.col("part") == "email-body", F.lit("document")).otherwise(kind["source_type"]),
            "source_kind": F.when(is_mail, F.lit("document")).otherwise(kind["source_kind"]),
        }
    )
    parser = F.when(is_mail, F.col("part")).otherwise(F.col("source_type"))
    mismatch = ~guards.mime_matches_suffix(F.col("mime_type"), guards.file_suffix(uri))
    return hashed.withColumns(
        {
            "job_id": ids.job_id(F.col("channel"), F.col("source_id"), F.col("content_hash"), parser),
            "error": F.coalesce(F.col("error"), F.when(mismatch, F.concat(F.lit("mime type mismatch: "), F.col("mime_type")))),
        }
    )


def parse_jobs(jobs: DataFrame) -> DataFrame:
    """Add ``blocks`` and fill ``error`` for files that do not parse."""
    parsed = jobs.withColumn("parsed", F.when(F.col("error").isNull(), parse_blocks(F.col("source_uri"), F.col("content"))))
    return parsed.withColumns({"blocks": F.col("parsed.blocks"), "error": F.coalesce(F.col("error"), F.col("parsed.error"))}).drop("parsed")
