"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import py_compile
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on for right answers.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Rows and bytes handed to Python at a time: texts may be long, and a batch is held several times over by its worker.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
}

# Settings that only shape the physical plan.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Key lookups by literal list are checked against Parquet statistics and bloom filters.
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
}


def build_session(app_name: str = "attesta", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset so spark-submit decides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **TUNING_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the correctness settings and the bound of Arrow batches to a session somebody else created."""
    for key, value in {**REQUIRED_CONF, **BATCH_CONF}.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="attesta-"), "attesta.zip")
    with zipfile.PyZipFile(archive, "w") as package:
        try:
            package.writepy(root)  # byte code, so that workers do not compile
        except (OSError, py_compile.PyCompileError):
            pass  # a read-only installation ships sources only
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder, because there every
    task runs on the machine that owns it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = os.path.join(tempfile.gettempdir(), f"attesta-ckpt-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so several consumers share one computation of it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_checkpoint_dir(spark))
    return df.checkpoint(eager=True)
