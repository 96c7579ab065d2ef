"""Session settings the jobs are written for; all are ordinary Spark options a cluster may override."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Hot join keys are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose measured partitions are small is hashed instead of sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state lives off the heap.
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def packed(folder: str | None = None) -> str:
    """A zip of this package's modules, as ``--py-files`` takes it."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder or tempfile.mkdtemp(prefix="inspectlake-"), "inspectlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    return path


def ship(spark: SparkSession) -> None:
    """Sends the package to executors that do not have it installed: the functions in tasks import it."""
    spark.sparkContext.addPyFile(packed())
