"""Alert feed: decode or set aside for another attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.functions.keys import rfc3339_micros
from metricloom.functions.metrics import severity_from_name, severity_name
from metricloom.sources.frames_json import camel

_FIELDS = ["alert_id", "agent_id", "fleet_id", "severity", "message", "triggered_at"]
_SCHEMA = ", ".join(f"{s} string" for f in _FIELDS for s in dict.fromkeys((f, camel(f)))) + ", _corrupt string"


def decode_alerts(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON alerts into ``(alerts, dead_letter)``.

    A dead letter carries ``attempt``, the number of failed deliveries so far. Feeding the dead letters
    back in (column ``attempt`` kept) is the redelivery: a failure then raises the count by one.
    """
    attempt = F.col("attempt") if "attempt" in raw.columns else F.lit(0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    document = F.from_json(F.col(value_col).cast("string"), _SCHEMA, options)
    parsed = raw.select(
        F.col(value_col).alias("value"),
        attempt.cast("int").alias("attempt"),
        F.explode(F.array(document)).alias("_raw"),  # parse once, see decode_frames
    )

    def text(name: str):
        return F.coalesce(*[F.col(f"_raw.{s}") for s in dict.fromkeys((name, camel(name)))])

    code = F.coalesce(severity_from_name(text("severity")), text("severity").try_cast("int"))
    stamp = F.upper(text("triggered_at"))
    zoned = stamp.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    at = F.when(zoned, stamp).otherwise(F.concat(stamp, F.lit("Z"))).try_cast("timestamp")  # UTC unless it says otherwise
    bad = (
        F.col("_raw").isNull()
        | F.col("_raw._corrupt").isNotNull()
        | (text("severity").isNotNull() & code.isNull())
        | (text("triggered_at").isNotNull() & at.isNull())
    )
    flagged = parsed.withColumn("_bad", bad)
    alerts = flagged.filter(~F.col("_bad")).select(
        *[F.coalesce(text(n), F.lit("")).alias(n) for n in ("alert_id", "agent_id", "fleet_id")],
        F.coalesce(code, F.lit(0)).alias("severity"),
        severity_name(F.coalesce(code, F.lit(0))).alias("severity_name"),
        F.coalesce(text("message"), F.lit("")).alias("message"),
        at.alias("triggered_at"),
    )
    dead_letter = flagged.filter("_bad").select("value", (F.col("attempt") + 1).alias("attempt"))
    return alerts, dead_letter


def read_alerts(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON-lines alert files, as a table or as a stream."""
    return decode_alerts((spark.readStream if streaming else spark.read).text(path))


def alert_json() -> Column:
    """An alert as JSON text, lowerCamelCase with the severity name."""
    return F.to_json(
        F.struct(
            F.col("alert_id").alias("alertId"),
            F.col("agent_id").alias("agentId"),
            F.col("fleet_id").alias("fleetId"),
            F.col("severity_name").alias("severity"),
            F.col("message"),
            rfc3339_micros(F.col("triggered_at")).alias("triggeredAt"),
        )
    )
