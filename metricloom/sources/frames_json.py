"""JSON frames: decoding with a quarantine for what cannot be decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.functions.keys import rfc3339_micros
from metricloom.schemas import NETWORK_FIELDS, REASONS, SYSTEM_FIELDS

MAX_UINT64 = "18446744073709551615"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def _both_spellings(names) -> list[str]:
    return [spelling for name in names for spelling in dict.fromkeys((name, camel(name)))]


# A counter is read with some decimals, so that a fraction shows instead of being rounded away.
_JSON_TYPES = {"double": "double", "uint64": "decimal(24,4)"}


def _raw_schema() -> str:
    """Both spellings of every field. Counters may be numbers or strings, which ``decimal`` reads alike."""
    ids = [f"{n} string" for n in _both_spellings(["agent_id", "fleet_id", "collected_at", "idempotency_key"])]
    groups = []
    for name, fields in (("system", SYSTEM_FIELDS), ("network", NETWORK_FIELDS)):
        members = [f"{s}: {_JSON_TYPES[t]}" for f, t in fields.items() for s in _both_spellings([f])]
        groups.append(f"{name} struct<{', '.join(members)}>")
    return ", ".join([*ids, *groups, "labels map<string,string>", "_corrupt string"])


def _value(path: str, name: str) -> Column:
    return F.coalesce(*[F.col(f"{path}.{spelling}") for spelling in _both_spellings([name])])


def violation(field: str, description: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(description).alias("description"))


def _group(name: str, fields: dict[str, str]) -> Column:
    """The metric group of a frame; unset scalars are 0."""
    members = [
        F.coalesce(_value(f"_raw.{name}", f), F.lit(0)).cast("double" if t == "double" else "decimal(20,0)").alias(f)
        for f, t in fields.items()
    ]
    return F.when(F.col(f"_raw.{name}").isNotNull(), F.struct(*members)).alias(name)


def _violations(name: str, fields: dict[str, str]) -> list[Column]:
    found = []
    for field in [f for f, kind in fields.items() if kind == "uint64"]:
        value = _value(f"_raw.{name}", field)
        bad = (value < 0) | (value > F.lit(MAX_UINT64).cast("decimal(20,0)")) | (value != F.floor(value))
        found.append(F.when(bad, violation(f"{name}.{field}", "not a uint64")))
    return found


def decode_frames(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split a column of JSON frames into ``(frames, quarantine)``.

    snake_case and lowerCamelCase names and counters given as strings are all accepted. Other columns
    of ``raw`` (arrival time, message attributes) are kept. The quarantine has the payload and the reasons.
    Works on batch and streaming input.
    """
    kept = [c for c in raw.columns if c != value_col]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    document = F.from_json(F.col(value_col).cast("string"), _raw_schema(), options)
    # The parse sits in a one-element explode: a plain projection would be merged into the filter on the
    # reasons, and every check would parse the text again.
    payload = F.col(value_col).cast("string").alias("_payload")
    parsed = raw.select(*kept, payload, F.explode(F.array(document)).alias("_raw"))
    stamp = _value("_raw", "collected_at")
    at = F.upper(stamp).try_cast("timestamp")
    undecodable = F.col("_raw").isNull() | F.col("_raw._corrupt").isNotNull()
    reasons = F.when(undecodable, F.array(violation("", "not a JSON frame"))).otherwise(
        F.array_compact(
            F.array(
                F.when(~stamp.rlike(RFC3339) | (stamp.isNotNull() & at.isNull()), violation("collected_at", "not an RFC 3339 time")),
                *_violations("system", SYSTEM_FIELDS),
                *_violations("network", NETWORK_FIELDS),
            )
        )
    )
    checked = parsed.withColumn("reasons", reasons.cast(REASONS))
    frames = checked.filter(F.size("reasons") == 0).select(
        *kept,
        F.coalesce(_value("_raw", "agent_id"), F.lit("")).alias("agent_id"),
        F.coalesce(_value("_raw", "fleet_id"), F.lit("")).alias("fleet_id"),
        at.alias("collected_at"),
        F.coalesce(_value("_raw", "idempotency_key"), F.lit("")).alias("idempotency_key"),
        _group("system", SYSTEM_FIELDS),
        _group("network", NETWORK_FIELDS),
        F.coalesce(F.col("_raw.labels"), F.expr("cast(map() as map<string,string>)")).alias("labels"),
    )
    quarantine = checked.filter(F.size("reasons") > 0).select(*kept, F.col("_payload").alias("value"), "reasons")
    return frames, quarantine


def decode_frames_protobuf(raw: DataFrame, descriptor_path: str, message: str = "MetricFrame") -> DataFrame:
    """Binary frames through Spark's protobuf package, which must be on the classpath.

    Undecodable payloads become null messages and are dropped.
    """
    from pyspark.sql.protobuf.functions import from_protobuf

    decoded = from_protobuf("value", message, descriptor_path, {"mode": "PERMISSIVE"})
    return raw.withColumn("_m", decoded).filter("_m is not null").select("_m.*", *[c for c in raw.columns if c != "value"])


def frame_json(names: str = "snake") -> Column:
    """A frame as JSON text, in snake_case or in lowerCamelCase with 64-bit integers as strings."""
    spell = camel if names == "camel" else str

    def group(name: str, fields: dict[str, str]) -> Column:
        members = [
            (F.col(f"{name}.{f}").cast("string") if t == "uint64" and names == "camel" else F.col(f"{name}.{f}")).alias(
                spell(f)
            )
            for f, t in fields.items()
        ]
        return F.when(F.col(name).isNotNull(), F.struct(*members)).alias(name)

    return F.to_json(
        F.struct(
            F.col("agent_id").alias(spell("agent_id")),
            F.col("fleet_id").alias(spell("fleet_id")),
            rfc3339_micros(F.col("collected_at")).alias(spell("collected_at")),
            F.col("idempotency_key").alias(spell("idempotency_key")),
            group("system", SYSTEM_FIELDS),
            group("network", NETWORK_FIELDS),
            F.col("labels"),
        )
    )


def read_frames_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines files of frames."""
    return decode_frames(spark.read.text(path))


def stream_frames_json(spark: SparkSession, path: str, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same as a stream over arriving files; one file is read once."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return decode_frames(reader.text(path))


def stream_topic_kafka(spark: SparkSession, servers: str, topic: str) -> tuple[DataFrame, DataFrame]:
    """The same over a Kafka topic; needs Spark's Kafka package. Publish time becomes the arrival time."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
        .select("value", F.col("timestamp").alias("received_at"))
    )
    return decode_frames(raw)
