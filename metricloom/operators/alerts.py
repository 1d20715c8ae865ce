"""Alerts, receipts, the response stream, history and per-agent feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricloom.functions.keys import interval_micros, time_bucket
from metricloom.functions.metrics import severity_name
from metricloom.functions.text import stable_id
from metricloom.operators.asof import asof_last
from metricloom.schemas import ALERT_BUFFER, ALERT_MESSAGE, CRITICAL


def alert_columns(triggered_at: Column) -> list[Column]:
    """The alert of a frame. The id depends on the accepted arrival only, so a replay repeats it."""
    arrival = F.unix_micros("received_at").cast("string")
    return [
        stable_id(F.col("idempotency_key"), arrival).alias("alert_id"),
        F.col("agent_id"),
        F.col("fleet_id"),
        F.lit(CRITICAL).alias("severity"),
        severity_name(F.lit(CRITICAL)).alias("severity_name"),
        F.lit(ALERT_MESSAGE).alias("message"),
        triggered_at.alias("triggered_at"),
    ]


def build_alerts(detected: DataFrame, triggered_at: Column | None = None) -> DataFrame:
    """One alert per anomalous frame; the trigger time defaults to the arrival time."""
    return detected.filter("is_anomaly").select(
        *alert_columns(F.col("received_at") if triggered_at is None else triggered_at)
    )


def acks(marked: DataFrame) -> DataFrame:
    """One receipt per frame; a duplicate's receipt has no receive time."""
    return marked.select(
        "idempotency_key", F.when(~F.col("is_duplicate"), F.col("received_at")).alias("server_received_at")
    )


def responses(marked: DataFrame) -> DataFrame:
    """Response stream of marked and detected frames: ``(arrival_seq, ord, kind, ack, alert)``.

    The alert of an accepted frame comes before its ack. Both come out of one pass over the frames.
    """
    fires = F.col("is_anomaly") & ~F.col("is_duplicate")
    alert = F.struct(*alert_columns(F.col("received_at")))
    ack = F.struct(
        F.col("idempotency_key"),
        F.when(~F.col("is_duplicate"), F.col("received_at")).alias("server_received_at"),
    )
    return marked.select(
        "arrival_seq",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        fires,
                        F.struct(
                            F.lit(0).alias("ord"),
                            F.lit("alert").alias("kind"),
                            F.when(F.lit(False), ack).alias("ack"),
                            F.when(F.lit(True), alert).alias("alert"),
                        ),
                    ),
                    F.struct(
                        F.lit(1).alias("ord"),
                        F.lit("ack").alias("kind"),
                        F.when(F.lit(True), ack).alias("ack"),
                        F.when(F.lit(False), alert).alias("alert"),
                    ),
                )
            )
        ).alias("_r"),
    ).select("arrival_seq", "_r.*")


def agent_alerts(alerts: DataFrame, agent_id: str) -> DataFrame:
    """Feed of one agent; the fleet plays no part."""
    if not agent_id:
        raise ValueError("agent_id is required")
    return alerts.filter(F.col("agent_id") == agent_id)


def alert_history(alerts: DataFrame, fleet_id: str, limit: int) -> DataFrame:
    """Newest ``limit`` alerts of a fleet."""
    return alerts.filter(F.col("fleet_id") == fleet_id).orderBy(F.desc("triggered_at"), "alert_id").limit(limit)


def with_subscriber(alerts: DataFrame, subscriptions: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Alerts with ``subscribed_at``: the registration in force for their agent, null when there is none.

    An agent has one registration at a time; a newer one replaces it. With an ``unsubscribed_at`` column,
    the end of any stream removes the agent's registration, also one that had replaced the ended stream's.
    """
    events = subscriptions.select(
        "agent_id", F.col("subscribed_at").alias("_at"), F.lit(1).alias("_open"), "subscribed_at"
    )
    if "unsubscribed_at" in subscriptions.columns:
        events = events.unionByName(
            subscriptions.filter("unsubscribed_at is not null").select(
                "agent_id",
                F.col("unsubscribed_at").alias("_at"),
                F.lit(0).alias("_open"),
                F.lit(None).cast("timestamp").alias("subscribed_at"),
            )
        )
    return asof_last(
        alerts, events, on="agent_id", left_time="triggered_at", right_time="_at",
        values=["subscribed_at"], tie_break="_open", bucket=bucket,
    )


def route_alerts(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts that reach a subscriber."""
    return with_subscriber(alerts, subscriptions).filter("subscribed_at is not null")


def undelivered(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts raised while nobody was registered for their agent."""
    return with_subscriber(alerts, subscriptions).filter("subscribed_at is null").drop("subscribed_at")


def deliver(routed: DataFrame, cap: int = ALERT_BUFFER, slot: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """``(delivered, overflow)``: a subscriber's buffer takes the ``cap`` oldest alerts of every time slot.

    Slots are fixed, so the answer does not depend on how the alerts came in. Both parts are alerts; none is lost.
    """
    at = time_bucket(F.col("triggered_at"), interval_micros(slot))
    order = Window.partitionBy("agent_id", at).orderBy("triggered_at", "alert_id")
    placed = routed.withColumn("_rn", F.row_number().over(order))
    return placed.filter(F.col("_rn") <= cap).drop("_rn"), placed.filter(F.col("_rn") > cap).drop("_rn")
