"""Window job that keeps its late rows: windows, late rows and open windows together hold every anomaly.

A row is late when its window was closed before its batch began, that is when the window's end is not above the latest time seen in
earlier batches less the delay. Late rows go to a table of their own instead of being dropped. Open windows are sums and counts in
a snapshot per batch; all parts are written once per batch, the clock last, so a batch that comes again changes nothing.

Tables below ``out``: ``windows`` (each window once), ``late``, ``open`` and ``clock`` (the newest batch holds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.functions.keys import interval_micros
from metricloom.operators.windows import extract
from metricloom.schemas import WINDOW
from metricloom.streaming.tables import drop_snapshot, latest_batch, read_snapshot, write_batch

OPEN = "fleet_id string, window_start timestamp, window_end timestamp, anomaly_count bigint, cpu_sum double"
CLOCK = "seen_us bigint, late_rows bigint"
KEYS = ["fleet_id", "window_start", "window_end"]


def window_batch(anomalies: DataFrame, batch_id: int, out: str, window: str, delay: str, time_col: str) -> None:
    """Add one batch: late rows aside, the others to their windows, and windows that are over to the table."""
    spark, wait = anomalies.sparkSession, interval_micros(delay)
    before = read_snapshot(spark, f"{out}/clock", CLOCK, batch_id - 1).agg(F.max("seen_us")).first()[0]
    bounds = F.window("event_time", window).alias("_w")
    rows = extract(anomalies, time_col).select("fleet_id", "agent_id", "event_time", "cpu", bounds)
    rows = rows.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
    closed = F.lit(False) if before is None else F.unix_micros("window_end") <= before - wait
    seen, late = rows.agg(F.max(F.unix_micros("event_time")), F.count_if(closed)).first()
    seen = max((s for s in (before, seen) if s is not None), default=None)
    write_batch(rows.filter(closed), f"{out}/late", batch_id)
    fresh = rows.filter(~closed).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("anomaly_count"), F.sum("cpu").alias("cpu_sum"))
    both = read_snapshot(spark, f"{out}/open", OPEN, batch_id - 1).unionByName(fresh)
    both = both.groupBy(*KEYS).agg(F.sum("anomaly_count").alias("anomaly_count"), F.sum("cpu_sum").alias("cpu_sum"))
    over = F.lit(False) if seen is None else F.unix_micros("window_end") <= seen - wait
    mean = (F.col("cpu_sum") / F.col("anomaly_count")).alias("avg_cpu_during_anomalies")
    write_batch(both.filter(over).select(*KEYS, "anomaly_count", mean), f"{out}/windows", batch_id)
    write_batch(both.filter(~over), f"{out}/open", batch_id)
    write_batch(spark.createDataFrame([(seen, late)], CLOCK), f"{out}/clock", batch_id)
    drop_snapshot(spark, f"{out}/open", batch_id - 2)


def run_late_windows(
    anomalies: DataFrame,
    out: str,
    checkpoint: str,
    window: str = WINDOW,
    delay: str = "10 minutes",
    time_col: str = "received_at",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the job over a stream of anomalies."""
    return (
        anomalies.writeStream.foreachBatch(lambda batch, n: window_batch(batch, n, out, window, delay, time_col))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_open(spark: SparkSession, out: str) -> DataFrame:
    """Windows that are not over yet."""
    return read_snapshot(spark, f"{out}/open", OPEN, latest_batch(spark, f"{out}/open"))


def late_counts(spark: SparkSession, out: str) -> DataFrame:
    """Late rows per batch."""
    return spark.read.parquet(f"{out}/clock").select("batch_id", "late_rows")
