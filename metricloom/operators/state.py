"""Latest state per fleet and agent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.functions.keys import unix_ms
from metricloom.functions.metrics import cpu_or_zero
from metricloom.schemas import STATE_TTL_MS

STATE_KEY = ["fleet_id", "agent_id"]


def last_arrival(rows: DataFrame) -> DataFrame:
    """Last arrival per fleet and agent, even when it was collected earlier than the one before.

    One ``max_by`` per number instead of one over a struct: fixed-width buffers allow the hash aggregate,
    whereas a struct would force a sort of the whole input. ``arrival_seq`` is unique, so the three agree.
    """
    return rows.groupBy(*STATE_KEY).agg(
        *[F.max_by(c, "arrival_seq").alias(c) for c in ("cpu", "last_seen_ms", "status")]
    )


def state_rows(detected: DataFrame) -> DataFrame:
    return detected.select(
        *STATE_KEY,
        cpu_or_zero().alias("cpu"),
        unix_ms(F.col("collected_at")).alias("last_seen_ms"),
        F.col("severity").alias("status"),
        "arrival_seq",
    )


def latest_state(detected: DataFrame) -> DataFrame:
    """State table of detected frames."""
    return last_arrival(state_rows(detected))


def advance_state(state: DataFrame, detected: DataFrame) -> DataFrame:
    """The state table after more frames: rows of the old table precede every new arrival."""
    before = state.withColumn("arrival_seq", F.lit(-1).cast("bigint"))
    return last_arrival(before.unionByName(state_rows(detected)))


def expired(as_of: datetime | Column, ttl_ms: int = STATE_TTL_MS) -> Column:
    """Strictly older than the limit; a time in the future never expires."""
    now = unix_ms(as_of if isinstance(as_of, Column) else F.lit(as_of))
    seen = F.col("last_seen_ms")
    return (now > seen) & (now - seen > ttl_ms)


def active(state: DataFrame, as_of: datetime | Column, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    return state.filter(~expired(as_of, ttl_ms))


def state_stream(detected: DataFrame) -> DataFrame:
    """Streaming form in Spark's state store, for update mode: partial aggregation, then one row per agent.

    Expired agents are filtered when the table is read (:func:`active`); the ingest job also evicts them.
    """
    return latest_state(detected)
