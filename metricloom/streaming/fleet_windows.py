"""Window job: follow the anomaly messages and append closed fleet windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.functions.keys import utc_date
from metricloom.operators.windows import fleet_windows
from metricloom.schemas import ANOMALY_MESSAGES, FLEET_WINDOWS, WINDOW
from metricloom.sources.frames_json import decode_frames


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The anomaly table as a stream of frames; undecodable payloads are dropped."""
    reader = spark.readStream.schema(f"{ANOMALY_MESSAGES}, batch_id bigint")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    frames, _ = decode_frames(reader.parquet(path).withColumnRenamed("published_at", "received_at"), "payload")
    return frames


def run_windows(
    anomalies: DataFrame,
    out: str,
    checkpoint: str,
    window: str = WINDOW,
    delay: str = "10 minutes",
    time_col: str = "received_at",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the window job over a stream of anomalous frames.

    Windows go by arrival unless ``time_col`` says otherwise: an agent's clock that is ahead would move the watermark
    past everyone else's windows, and frames without a clock would be in none. Append mode: a window is written once, after the watermark passed its end; rows later than ``delay`` are
    dropped and counted in the query progress (``numRowsDroppedByWatermark``).
    """
    rows = fleet_windows(anomalies, window, time_col, delay).withColumn("window_date", utc_date(F.col("window_start")))
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("window_date")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """Window rows written so far, with the table's column types."""
    return spark.read.schema(f"{FLEET_WINDOWS}, window_date date").parquet(out)
