"""Outputs: event files, latest snapshots, partitioned results, reports, manifests and model assets."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``, a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if folder is None and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "inspectlake-checkpoints")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def append_events(events: DataFrame, path: str) -> None:
    """One JSON line per event, added to what is there."""
    events.write.mode("append").json(path)


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """Event lines of a stream, each batch once: the sink's log names the files of finished batches.

    A batch that is tried again writes new files and its log entry replaces nothing twice, and readers go by the log.
    """
    return events.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def write_by_day(results: DataFrame, path: str, time_us: str = "ts_us", station: str = "station_id") -> None:
    """Results by day and station.  The rebalance lets Spark split a busy station and join small ones."""
    day = F.date_format(F.timestamp_micros(time_us), "yyyyMMdd")
    rows = results.withColumn("day", day).hint("rebalance", "day", station)
    rows.write.mode("append").partitionBy("day", station).parquet(path)


def write_diagnostics(reports: dict[str, DataFrame], path: str) -> None:
    """One table per report."""
    for name, rows in reports.items():
        rows.write.mode("append").parquet(f"{path}/{name}")


def raw_frame_rows(frames: DataFrame) -> DataFrame:
    """Frame listing written beside the samples."""
    names = ["sequence_id", "recipe_id", "sku", "camera_id", "pose_id", "light_id", "frame_index", "shot_id", "timestamp_us", "width", "height", "pixel_format", "dtype"]
    return frames.select(*[n for n in names if n in frames.columns])


def write_manifest(samples: DataFrame, summary: DataFrame, skipped: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(f"{path}/manifest")
    summary.write.mode("overwrite").json(f"{path}/summary")
    skipped.write.mode("overwrite").json(f"{path}/skipped")


def content_key(rows: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free hash of their content."""
    digest = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.coalesce(digest, F.lit("")), 256).alias("content_hash"))


def write_model_assets(
    version: str, bank: DataFrame, thresholds: DataFrame, pca: DataFrame | None, path: str, id_col: str = "vec_id", inputs: dict[str, DataFrame] | None = None
) -> str:
    """Bank, thresholds and PCA of one version, and a contract with the hash of each and of the tables they came from."""
    folder = f"{path}/version={version}"
    parts = {"bank": bank, "thresholds": thresholds} | ({} if pca is None else {"pca": pca})
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = bank.sparkSession
    lines = [content_key(spark.read.parquet(f"{folder}/{name}")).select(F.lit("asset").alias("kind"), F.lit(name).alias("name"), "*") for name in parts]
    lines += [content_key(rows).select(F.lit("input").alias("kind"), F.lit(name).alias("name"), "*") for name, rows in (inputs or {}).items()]
    contract = reduce(lambda a, b: a.unionByName(b), lines).withColumns({"version": F.lit(version), "has_pca": F.lit(pca is not None)})
    contract.coalesce(1).write.mode("overwrite").json(f"{folder}/contract")
    return folder


CONTRACT = "kind string, name string, rows long, content_hash string, version string, has_pca boolean"


def asset_contract(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's lines with ``intact``: whether an asset's rows are still those that were written."""
    contract = spark.read.schema(CONTRACT).json(f"{folder}/contract")
    names = [r["name"] for r in contract.where("kind = 'asset'").select("name").collect()]
    now = reduce(lambda a, b: a.unionByName(b), [content_key(spark.read.parquet(f"{folder}/{n}")).select(F.lit(n).alias("name"), F.col("content_hash").alias("_now")) for n in names])
    return contract.join(now, "name", "left").withColumn("intact", F.when(F.col("kind") == "asset", F.col("_now") == F.col("content_hash"))).drop("_now")


def write_evaluation(totals: DataFrame, per_image: DataFrame, path: str) -> None:
    totals.write.mode("overwrite").json(f"{path}/totals")
    per_image.write.mode("overwrite").json(f"{path}/images")


def write_reviews(queue: DataFrame, actions: DataFrame, path: str, version: int = 0) -> None:
    """A new version of the queue beside the old ones; actions are only ever added.

    Readers take the newest finished version, so none sees half a queue, and writing a version again replaces it.
    """
    write_version(queue, f"{path}/queue", version)
    write_version(actions, f"{path}/actions", version)


# --- versioned snapshots ------------------------------------------------------------------------


def write_version(rows: DataFrame, path: str, version: int) -> None:
    """Snapshot ``version`` of a table.  Writing the same version again replaces it, so a retried batch is harmless."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """Rows of the highest finished snapshot (below a version), or None."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    versions = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            versions.append(int(name.split("=")[1]))
    versions = [v for v in versions if below is None or v < below]
    return spark.read.parquet(f"{path}/version={max(versions)}") if versions else None


def merge_latest(current: DataFrame | None, events: DataFrame, station: str = "station_id") -> DataFrame:
    """Latest event per station.  An enrichment replaces the latest only when it is the same event.

    ``events`` has sequence_id, trigger_id, timestamp_ms and ``enrichment``; of two versions of one event
    the later ``revision`` counts.
    """
    columns = [c for c in events.columns if c not in (station, "enrichment")]
    body = F.struct(*columns)
    fresh = events.where(~F.col("enrichment")).drop("enrichment")
    base = fresh if current is None else fresh.unionByName(current.select(*fresh.columns))
    order = F.struct("timestamp_ms", "sequence_id", "trigger_id", "revision")
    latest = base.groupBy(station).agg(F.max_by(body, order).alias("l"))
    better = events.where("enrichment").select(station, "sequence_id", "trigger_id", "timestamp_ms", body.alias("e"))
    on = (
        (latest[station] == better[station])
        & (F.col("l.sequence_id") == better["sequence_id"])
        & (F.col("l.trigger_id") == better["trigger_id"])
        & (F.col("l.timestamp_ms") == better["timestamp_ms"])
        & (F.col("e.revision") > F.col("l.revision"))
    )
    joined = latest.join(better, on, "left")
    chosen = joined.groupBy(latest[station], "l").agg(F.max_by("e", "e.revision").alias("e"))
    return chosen.select(station, F.coalesce("e", "l").alias("r")).select(station, "r.*")
