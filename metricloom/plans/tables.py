"""Frames and logs derived from the driver's event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from metricloom.session import prepare
from metricloom.streaming.tables import list_names


_SCHEMAS: dict[str, StructType] = {}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up once, as every look-up runs a job over the file footers."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = prepare(spark).read.parquet(path).schema
    return prepare(spark).read.schema(_SCHEMAS[path]).parquet(path)


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Region name per user: small dimension tables joined before the events."""
    customer = _read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = _read(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = _read(spark, folder, "region").select("r_regionkey", "r_name")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return customer.join(named, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("user_id"), F.col("r_name").alias("region")
    )


def as_frames(events: DataFrame, region: DataFrame | None = None) -> DataFrame:
    """Events as frames. Without ``region`` the label map has the event type only and no join is needed."""
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("bigint")
    at = F.col("ts").cast("timestamp")
    system = F.struct(
        F.least(value, F.lit(100.0)).alias("cpu_utilization_pct"),
        (k * 83).alias("memory_used_bytes"),
        F.when(F.col("event_id") % 10 == 0, 0).otherwise(8192).cast("bigint").alias("memory_total_bytes"),
        (value / 4).alias("disk_io_read_mbps"),
        (value / 8).alias("disk_io_write_mbps"),
    )
    network = F.struct(
        (value / 10).alias("rx_mbps"),
        (value / 20).alias("tx_mbps"),
        (k % 3).alias("tcp_retransmit_count"),
        k.alias("connection_count"),
    )
    labels = [F.lit("event_type"), F.col("event_type")]
    if region is not None:
        events = events.join(region, "user_id", "left")
        labels = [F.lit("region"), F.col("region"), *labels]
    stream = F.md5(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(at, "yyyy-MM-dd")))
    span = F.substring(F.md5(F.col("event_id").cast("string")), 1, 16)
    return events.select(
        F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("agent_id"),
        F.concat(F.lit("fleet-"), (F.col("user_id") % 8).cast("string")).alias("fleet_id"),
        at.alias("collected_at"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("idempotency_key"),
        F.when(F.col("event_type") != "signup", system).alias("system"),
        F.when(F.col("event_type") != "view", network).alias("network"),
        F.create_map(*labels).alias("labels"),
        (at + F.expr("interval 1 second")).alias("received_at"),
        F.col("event_id").alias("arrival_seq"),
        F.concat(F.lit("00-"), stream, F.lit("-"), span, F.lit("-01")).alias("traceparent"),
    )


def frames(spark: SparkSession, folder: str, labelled: bool = False) -> DataFrame:
    """One frame per event; ``labelled`` adds the region label, which costs the customer join."""
    return as_frames(_read(spark, folder, "events"), regions(spark, folder) if labelled else None)


# (every n-th event, arrival delay in seconds, offset of the arrival number)
REDELIVERIES = [(20, 60, 10**9), (50, 1200, 2 * 10**9)]


def redelivered(rows: DataFrame) -> DataFrame:
    """The frames and their redeliveries, out of one pass over the frames."""
    seq, at = F.col("arrival_seq"), F.col("collected_at")
    arrivals = [F.struct(F.col("received_at").alias("at"), seq.alias("seq"))]
    for every, delay, offset in REDELIVERIES:
        later = F.struct((at + F.expr(f"interval {delay} seconds")).alias("at"), (seq + offset).alias("seq"))
        arrivals.append(F.when(seq % every == 0, later))
    return (
        rows.withColumn("_a", F.explode(F.array_compact(F.array(*arrivals))))
        .withColumn("received_at", F.col("_a.at"))
        .withColumn("arrival_seq", F.col("_a.seq"))
        .drop("_a")
    )


def deliveries(spark: SparkSession, folder: str, labelled: bool = False) -> DataFrame:
    """Everything that arrives: every frame, some of them again after 1 and after 20 minutes."""
    return redelivered(frames(spark, folder, labelled))


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event file(s) as a stream."""
    schema = _read(spark, folder, "events").schema
    # As a glob: a plain path of a streaming source must be a folder, and this table may be a single file.
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def stream_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that arrives, as a stream over the event file(s)."""
    return redelivered(as_frames(stream_events(spark, folder)))


#: Rows of a file that a micro-batch reads, on average; each file is a task's.
STAGED_ROWS = 250_000


def _stage(parts: list[DataFrame], rows: int, path: str) -> DataFrame:
    """A stream of which every micro-batch is one of ``parts``, written to ``path`` one after another; ``rows`` are in all of them.

    Every part gets the same number of files, as a micro-batch takes so many; where rows are too few for that, some are empty.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    files = max(1, -(-rows // (len(parts) * STAGED_ROWS)))
    for number, part in enumerate(parts, 1):
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(path)
        written = len([name for name in list_names(spark, path) if name.endswith(".parquet")])
        for _ in range(number * files - written):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def staged_events(spark: SparkSession, folder: str, path: str, parts: int = 4, late: int = 0) -> DataFrame:
    """The event table as a stream of ``parts`` micro-batches: written to ``path`` in ranges of time, one after another.

    With ``late``, every so many-th event comes in the last batch, whatever its time.
    """
    events = _read(spark, folder, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last, count = events.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    part = F.least(F.floor((at - first) * parts / max(1, last - first)), F.lit(parts - 1)) if last is not None else F.lit(0)
    if late:
        part = F.when(F.col("event_id") % late == 0, F.lit(parts - 1)).otherwise(part)
    return _stage([events.filter(part == number) for number in range(parts)], count, path)


def time_span(rows: DataFrame, time_col: str) -> tuple[int | None, int | None]:
    """First and last time in microseconds."""
    return tuple(rows.agg(F.min(F.unix_micros(time_col)), F.max(F.unix_micros(time_col))).first())


def staged(
    rows: DataFrame, path: str, time_col: str, parts: int = 4, span: tuple[int | None, int | None] | None = None, then: Sequence[DataFrame] = ()
) -> DataFrame:
    """``rows`` as a stream of ``parts`` micro-batches: written to ``path`` in ranges of time, one after another.

    The ranges cut ``span``, by default that of the rows; streams staged over one span go together. Each table of ``then`` is a
    micro-batch more.
    """
    at = F.unix_micros(time_col)
    least, most, count = rows.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    first, last = span or (least, most)
    part = F.lit(0)
    if last is not None:
        part = F.greatest(F.least(F.floor((at - first) * parts / max(1, last - first)), F.lit(parts - 1)), F.lit(0))
    return _stage([*(rows.filter(part == number) for number in range(parts)), *then], count, path)


def rpc_log(spark: SparkSession, folder: str) -> DataFrame:
    """One request per event; the value is its duration in milliseconds."""
    at, seconds = F.col("ts").cast("timestamp"), F.col("value") / 1000
    micros = F.round(F.col("value") * 1000).cast("bigint")
    return _read(spark, folder, "events").select(
        F.col("event_type").alias("method"),
        at.alias("started_at"),
        F.timestamp_micros(F.unix_micros(at) + micros).alias("ended_at"),
        seconds.alias("duration_s"),
        F.when(F.col("event_type") == "error", "INTERNAL").otherwise("OK").alias("code"),
    )


def frame_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log record of every frame received, with its trace context."""
    return frames(spark, folder).select(
        "traceparent",
        F.col("received_at").alias("logged_at"),
        F.when(F.col("labels")["event_type"] == "error", "INTERNAL").otherwise("OK").alias("code"),
    )


def fleets(spark: SparkSession, folder: str) -> DataFrame:
    """Fleet number per fleet that has frames."""
    number = F.col("user_id") % 8
    return _read(spark, folder, "events").select(number.alias("fleet_no")).distinct()


def policies(spark: SparkSession, folder: str) -> DataFrame:
    """Even fleets enabled with 60/80, fleet 1 disabled with 10/10, the others without a policy."""
    no = F.col("fleet_no")
    even = no % 2 == 0
    return (
        fleets(spark, folder)
        .filter(even | (no == 1))
        .select(
            F.concat(F.lit("policy-"), no.cast("string")).alias("policy_id"),
            F.concat(F.lit("fleet-"), no.cast("string")).alias("fleet_id"),
            F.when(even, 60.0).otherwise(10.0).alias("cpu_threshold_pct"),
            F.when(even, 80.0).otherwise(10.0).alias("memory_threshold_pct"),
            even.alias("enabled"),
        )
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Every third agent registers on the 5th and again on the 15th of January 2024."""
    days = F.explode(F.array(*[F.lit(day).cast("timestamp") for day in ("2024-01-05", "2024-01-15")]))
    return (
        _read(spark, folder, "events")
        .select("user_id")
        .distinct()
        .filter(F.col("user_id") % 3 == 0)
        .select(
            F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("agent_id"),
            F.concat(F.lit("fleet-"), (F.col("user_id") % 8).cast("string")).alias("fleet_id"),
            days.alias("subscribed_at"),
        )
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each fleet asks for as many rows as its number plus 3, fleet 0 for 0 rows, and one fleet is unknown."""
    no = F.col("fleet_no")
    known = fleets(spark, folder).select(
        F.concat(F.lit("fleet-"), no.cast("string")).alias("fleet_id"),
        F.when(no == 0, 0).otherwise(no + 3).cast("int").alias("last_n_rows"),
    )
    return known.unionByName(spark.createDataFrame([("fleet-unknown", 5)], known.schema))
