"""Tumbling-window aggregates of anomalies per fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.functions.keys import rfc3339, utc_date
from metricloom.functions.metrics import cpu_or_zero
from metricloom.functions.text import label
from metricloom.schemas import WINDOW


def extract(anomalies: DataFrame, time_col: str, more: list[str] | None = None) -> DataFrame:
    """Fleet, agent and CPU per anomaly, and ``more`` columns; anomalies without a fleet are dropped.

    One without the time asked for counts at its arrival (at the epoch if that is not known either).
    """
    times = [F.col(c) for c in dict.fromkeys((time_col, "received_at")) if c in anomalies.columns]
    return anomalies.filter(F.col("fleet_id") != "").select(
        F.coalesce(*times, F.timestamp_micros(F.lit(0))).alias("event_time"), "fleet_id", "agent_id", cpu_or_zero().alias("cpu"), *(more or [])
    )


def fleet_windows(
    anomalies: DataFrame,
    window: str = WINDOW,
    time_col: str = "collected_at",
    delay: str | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Count and mean CPU per window and fleet; the same plan in batch and streaming.

    ``delay`` is the watermark of the streaming form: rows later than it are dropped, and in append mode a
    window comes out once, when the watermark passes its end. ``extra`` adds aggregates of the extracted
    columns (``cpu``, ``agent_id``, ``event_time``), any built-in or user-defined one. A fleet that holds most
    rows shrinks in the partial aggregate, before the exchange.
    """
    rows = extract(anomalies, time_col)
    if delay is not None:
        rows = rows.withWatermark("event_time", delay)
    return (
        rows.groupBy(F.window("event_time", window).alias("_w"), "fleet_id")
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.avg("cpu").alias("avg_cpu_during_anomalies"),
            *[value.alias(name) for name, value in (extra or {}).items()],
        )
        .select(
            "fleet_id",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "anomaly_count",
            "avg_cpu_during_anomalies",
            *(extra or {}),
        )
    )


def format_windows(windows: DataFrame) -> DataFrame:
    """Window rows with RFC 3339 bounds."""
    return windows.withColumn("window_start", rfc3339(F.col("window_start"))).withColumn(
        "window_end", rfc3339(F.col("window_end"))
    )


def fleet_region_day(anomalies: DataFrame, time_col: str = "collected_at") -> DataFrame:
    """Per-fleet aggregates by date and region; the mean comes from the rows, not from window means."""
    return (
        anomalies.filter(F.col("fleet_id") != "")
        .select(
            utc_date(F.col(time_col)).alias("window_date"),
            label(F.col("labels"), "region").alias("region"),
            "fleet_id",
            cpu_or_zero().alias("cpu"),
        )
        .groupBy("window_date", "region", "fleet_id")
        .agg(F.count(F.lit(1)).alias("anomaly_count"), F.avg("cpu").alias("avg_cpu_during_anomalies"))
    )
