"""Stored tables that move from one schema version to the next, with a ledger of checksums.

Every version of the rows has a folder of its own (``v=<n>``). A step is declared as SQL
expressions over the version before, so its checksum covers all it does. The ledger holds, per
version, the step's checksum and the count and digest of the rows it left. A version without a
ledger row broke off: it is written again from the version before, which no step changes.

Refused: a step that differs from the one the ledger names, rows that differ from the digest they
were left with, a step that loses or adds rows, and versions with gaps.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "version int, name string, checksum string, rows long, digest string"


@dataclass(frozen=True)
class Step:
    """One version: columns set by SQL expressions over the version before, and columns left out."""

    version: int
    name: str
    columns: Mapping[str, str] = field(default_factory=dict)
    dropped: Sequence[str] = ()

    @property
    def checksum(self) -> str:
        said = [self.version, self.name, list(self.columns.items()), list(self.dropped)]
        return hashlib.sha256(json.dumps(said).encode()).hexdigest()

    def apply(self, rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in self.dropped and c not in self.columns]
        return rows.select(*[F.col(f"`{c}`") for c in kept], *[F.expr(e).alias(c) for c, e in self.columns.items()])


class Drift(RuntimeError):
    """What is stored does not agree with the ledger or with the declared steps."""


class VersionedTable:
    """Rows below one folder that all executors share, with the steps that lead to the newest version."""

    def __init__(self, spark: SparkSession, root: str, steps: Sequence[Step] = ()):
        self.spark, self.root = spark, root
        self.steps = sorted(steps, key=lambda s: s.version)
        if [s.version for s in self.steps] != list(range(2, len(self.steps) + 2)):
            raise ValueError("steps must be numbered from 2 without gaps; version 1 is what create() wrote")

    def _path(self, version: int) -> str:
        return f"{self.root}/v={version}"

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger").select("version", "name", "checksum", "rows", "digest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default the newest one that the ledger knows."""
        if version is None:
            version = self.ledger().agg(F.max("version")).first()[0]
            if version is None:
                raise Drift(f"nothing is recorded below {self.root}")
        return self.spark.read.parquet(self._path(version))

    def create(self, rows: DataFrame) -> None:
        """Write version 1; a replay replaces it as long as no later version is recorded."""
        if self.ledger().where("version > 1").limit(1).count():
            raise Drift("later versions are recorded already")
        rows.write.mode("overwrite").parquet(self._path(1))
        self._record(1, "create", "")

    def migrate(self) -> list[int]:
        """Apply the steps that are not recorded yet; returns their versions."""
        known = {r.version: r for r in self.ledger().collect()}  # one row for each version
        if 1 not in known:
            raise Drift(f"nothing is recorded below {self.root}")
        declared = {s.version: s.checksum for s in self.steps}
        drifted = sorted(v for v, r in known.items() if v > 1 and declared.get(v) != r.checksum)
        if drifted:
            raise Drift(f"steps differ from those recorded for versions {drifted}")
        done = []
        for step in self.steps:
            if step.version in known:
                continue
            before = known[step.version - 1]
            rows, digest = self._measure(step.version - 1)
            if (rows, digest) != (before.rows, before.digest):
                raise Drift(f"rows of version {step.version - 1} differ from those recorded")
            step.apply(self.read(step.version - 1)).write.mode("overwrite").parquet(self._path(step.version))
            known[step.version] = self._record(step.version, step.name, step.checksum, rows)
            done.append(step.version)
        return done

    def _measure(self, version: int) -> tuple[int, str]:
        """Count of the rows and a digest that does not depend on their order."""
        rows = self.read(version)
        each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)]).cast("decimal(20,0)")
        found = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("digest")).first()
        return found.rows, found.digest

    def _record(self, version: int, name: str, checksum: str, wanted: int | None = None):
        rows, digest = self._measure(version)
        if wanted is not None and rows != wanted:
            raise Drift(f"version {version} has {rows} rows, the one before had {wanted}")
        line = self.spark.createDataFrame([(version, name, checksum, rows, digest)], LEDGER)
        line.write.mode("overwrite").parquet(f"{self.root}/ledger/of={version}")
        return line.first()
