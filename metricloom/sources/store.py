"""Files of the frame store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from metricloom.functions.keys import utc_date
from metricloom.operators.store import apply_retention, merge_rows, store_rows, upsert_frames
from metricloom.schemas import FLEET_WINDOWS


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_date", utc_date(F.timestamp_millis("unix_ms")))


def batch_rows(frames: DataFrame) -> DataFrame:
    """Merged rows of one micro-batch, brought together by date for few files.

    The rebalance is adaptive: a date with many rows is split over tasks, small ones share a task.
    """
    rows = _dated(merge_rows(store_rows(frames))).hint("rebalance", "event_date")
    return rows.sortWithinPartitions("event_date", "row_key")


def write_frames(frames: DataFrame, path: str) -> None:
    """Append frames to a store partitioned by date."""
    _write_clustered(upsert_frames(frames), path)


def write_dated(rows: DataFrame, path: str) -> None:
    """Append store rows as they are, every version of a key, to a store partitioned by date."""
    _write_clustered(rows, path)


def _write_clustered(rows: DataFrame, path: str) -> None:
    """Range partitioning on the (unique) key splits hot agents and dates evenly and gives files with narrow
    key ranges, so the ``agent#`` prefix filter skips files and row groups."""
    ranged = _dated(rows).repartitionByRange("event_date", "row_key")
    ranged.sortWithinPartitions("event_date", "row_key").write.mode("append").partitionBy("event_date").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store, one row per key: rows of several writes are merged in write order."""
    rows = spark.read.parquet(path)
    return merge_rows(rows, write_order(rows))


def write_order(rows: DataFrame) -> list[str]:
    """What tells later writes: arrival numbers begin anew in every batch of the ingest job."""
    return ["batch_id", "arrival_seq"] if "batch_id" in rows.columns else ["arrival_seq"]


def compact_store(spark: SparkSession, path: str, out: str) -> None:
    """Write the merged store to a new folder: many small batch parts become few files in key order."""
    _write_clustered(read_store(spark, path), out)


def collect_garbage(spark: SparkSession, path: str, out: str, as_of: datetime, **limits: int) -> None:
    """Write what retention leaves of the store to a new folder (see ``apply_retention`` for the limits)."""
    rows = spark.read.parquet(path)
    _write_clustered(apply_retention(rows, as_of, order=write_order(rows), **limits).drop("version"), out)


def write_windows(windows: DataFrame, path: str) -> None:
    """Append batch window rows, partitioned by their date; the table is created when missing.

    The rows must fit the table's column types; text bounds (``format_windows``) do not.
    """
    rows = windows.to(T.StructType.fromDDL(FLEET_WINDOWS)).withColumn("window_date", utc_date(F.col("window_start")))
    rows.write.mode("append").partitionBy("window_date").parquet(path)


def write_region_days(rows: DataFrame, path: str) -> None:
    """Append aggregates by date and region to a table partitioned by both, each file in the order of fleets.

    The rebalance is adaptive: a large partition is split over tasks, small ones share a task.
    """
    keys = ["window_date", "region"]
    rows = rows.hint("rebalance", *keys).sortWithinPartitions(*keys, "fleet_id")
    rows.write.mode("append").partitionBy(*keys).parquet(path)
