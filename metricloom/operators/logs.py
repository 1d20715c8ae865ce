"""Agent text log: rendering and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# What the agent log writes for an ack, an alert and the status document.
ACK_TEXT = "Received ack for "
ALERT_TEXT = "Received alert! "
LINE_TIME = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) "
ACTIVE_COUNT = r'"activeAgentCount":(\d+)'


def render_log(responses: DataFrame) -> DataFrame:
    """One text line per response, column ``value``."""
    at = F.coalesce("ack.server_received_at", "alert.triggered_at")
    body = F.when(
        F.col("kind") == "alert",
        F.concat(F.lit(ALERT_TEXT), F.col("alert.severity_name"), F.lit(": "), F.col("alert.message")),
    ).otherwise(F.concat(F.lit(ACK_TEXT), F.col("ack.idempotency_key")))
    return responses.select(
        F.concat(F.coalesce(F.concat(F.date_format(at, "yyyy/MM/dd HH:mm:ss"), F.lit(" ")), F.lit("")), body).alias(
            "value"
        )
    )


def log_summary(text: DataFrame) -> DataFrame:
    """Lines per kind and second, and the active agent count of status lines."""
    line = F.col("value")
    kind = (
        F.when(line.contains("Received alert"), "alert")
        .when(line.contains(ACK_TEXT), "ack")
        .when(line.rlike(ACTIVE_COUNT), "status")
        .otherwise("other")
    )
    stamp = F.nullif(F.regexp_extract(line, LINE_TIME, 1), F.lit(""))
    count = F.nullif(F.regexp_extract(line, ACTIVE_COUNT, 1), F.lit("")).try_cast("bigint")
    return (
        text.select(
            kind.alias("kind"), F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd HH:mm:ss")).alias("second"), count.alias("_n")
        )
        .groupBy("kind", "second")
        .agg(F.count(F.lit(1)).alias("lines"), F.max("_n").alias("active_agents"))
    )
