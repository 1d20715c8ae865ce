"""Anomaly flags, severities and the anomaly messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricloom.functions.metrics import (
    Detector,
    severity_code,
    severity_name,
    threshold_detector,
)
from metricloom.functions.text import span_id, trace_id
from metricloom.schemas import DEFAULT_CPU_PCT, DEFAULT_MEMORY_PCT
from metricloom.sources.frames_json import frame_json


def detect(frames: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Adds ``is_anomaly``, ``severity`` and ``severity_name``.

    ``detector`` is any callable that returns a boolean column over the frame columns; a pandas UDF
    applied to columns is one.
    """
    flag = F.coalesce((detector or threshold_detector())(), F.lit(False))
    return (
        frames.withColumn("is_anomaly", flag)
        .withColumn("severity", severity_code(F.col("is_anomaly")))
        .withColumn("severity_name", severity_name(F.col("severity")))
    )


def anomalies(detected: DataFrame) -> DataFrame:
    return detected.filter("is_anomaly")


def one_policy_per_fleet(policies: DataFrame) -> DataFrame:
    """Enabled policies, the greatest ``policy_id`` winning when a fleet has several."""
    return (
        policies.filter("enabled")
        .groupBy("fleet_id")
        .agg(F.max_by(F.struct("cpu_threshold_pct", "memory_threshold_pct"), "policy_id").alias("_p"))
        .select("fleet_id", F.col("_p.cpu_threshold_pct"), F.col("_p.memory_threshold_pct"))
    )


def policy_detect(
    frames: DataFrame,
    policies: DataFrame,
    cpu: float = DEFAULT_CPU_PCT,
    memory: float = DEFAULT_MEMORY_PCT,
) -> DataFrame:
    """Detection with per-fleet limits; fleets without an enabled policy use the defaults.

    No broadcast hint: Spark broadcasts the policies while they are below its size threshold, and beyond
    that the adaptive skew join splits hot fleets (the policy side has one row per fleet).
    """
    limits = one_policy_per_fleet(policies)
    joined = frames.join(limits, "fleet_id", "left")
    detector = threshold_detector(
        F.coalesce(F.col("cpu_threshold_pct"), F.lit(float(cpu))),
        F.coalesce(F.col("memory_threshold_pct"), F.lit(float(memory))),
    )
    return detect(joined, detector)


def anomaly_messages(detected: DataFrame) -> DataFrame:
    """One message per anomaly: the whole frame as JSON, trace context and ids as attributes, and the time of arrival."""
    tracestate = F.col("tracestate") if "tracestate" in detected.columns else F.lit("")
    attributes = {
        "traceparent": F.coalesce("traceparent", F.lit("")),
        "tracestate": F.coalesce(tracestate, F.lit("")),
        "agent_id": F.col("agent_id"),
        "fleet_id": F.col("fleet_id"),
    }
    pairs = [part for name, value in attributes.items() for part in (F.lit(name), value)]
    published = F.col("received_at") if "received_at" in detected.columns else F.lit(None).cast("timestamp")
    return anomalies(detected).select(
        frame_json().alias("payload"), F.create_map(*pairs).alias("attributes"), published.alias("published_at")
    )


def trace_join(messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Messages with what the log holds on their trace: record count, first and last time, errors.

    All frames of one long-lived stream share a trace, as do their log records, so pairing records would
    grow with the product of both. The log is aggregated per trace first and the join adds one row per
    message at most; messages without a matching trace are left out.
    """
    per_trace = (
        logs.withColumn("trace_id", trace_id(F.col("traceparent")))
        .filter(F.col("trace_id").isNotNull())
        .groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("log_count"),
            F.min("logged_at").alias("first_logged_at"),
            F.max("logged_at").alias("last_logged_at"),
            F.count_if(F.col("code") != "OK").alias("error_count"),
        )
    )
    return messages.withColumn("trace_id", trace_id(F.col("attributes")["traceparent"])).join(per_trace, "trace_id")


def trace_records(messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Messages with the log records of their own span: message columns, trace_id, span_id, then the log's columns.

    A span belongs to one frame, so this grows with the input, unlike records paired by trace alone.
    """
    own = F.col("attributes")["traceparent"]
    left = messages.withColumns({"trace_id": trace_id(own), "span_id": span_id(own)})
    there = F.col("traceparent")
    right = logs.withColumns({"trace_id": trace_id(there), "span_id": span_id(there)}).drop("traceparent")
    return left.join(right.filter("trace_id is not null"), ["trace_id", "span_id"])
