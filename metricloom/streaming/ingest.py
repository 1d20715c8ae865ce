"""Ingest job: validate, mark duplicates, detect, and fan out to tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.functions.keys import interval_micros, time_bucket
from metricloom.functions.metrics import Detector
from metricloom.operators import alerts as alert_ops
from metricloom.operators.dedup import KEY, accepted, dead_after, mark
from metricloom.operators.detect import anomaly_messages, detect
from metricloom.operators.state import expired, last_arrival, state_rows
from metricloom.operators.validate import violations
from metricloom.schemas import AGENT_STATE, ALERT_BUFFER, DEDUP_SWEEP, DEDUP_TTL, SEEN_KEYS, STATE_TTL_MS
from metricloom.sources.frames_json import decode_frames, frame_json
from metricloom.sources.store import batch_rows
from metricloom.streaming.tables import batch_path, committed, drop_snapshot, latest_batch, write_batch

STATE_PARTS = f"{AGENT_STATE}, clock_ms bigint, ttl_ms bigint"


@dataclass(frozen=True)
class IngestOptions:
    """Limits of the ingest job. ``subscriptions`` turns on alert routing: a table, or the path of one, which is read anew for
    every micro-batch, so who subscribes later is seen without a restart."""

    detector: Detector | None = None
    ttl: str = DEDUP_TTL
    sweep: str = DEDUP_SWEEP
    state_ttl_ms: int = STATE_TTL_MS
    strict: bool = False
    subscriptions: DataFrame | str | None = None


def with_arrival_time(frames: DataFrame) -> DataFrame:
    """Fill in what the source does not give. In a stream the arrival time is that of the micro-batch, which
    is logged with its offsets: a replay sees the same."""
    if "received_at" not in frames.columns:
        frames = frames.withColumn("received_at", F.current_timestamp())
    if "traceparent" not in frames.columns:
        frames = frames.withColumn("traceparent", F.lit(None).cast("string"))
    return frames


def _write_all(spark: SparkSession, writes: list[Callable[[], None]]) -> None:
    """Run independent writes side by side; the first failure is raised after all have ended."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=len(writes)) as pool:
        for done in [pool.submit(inherit(write)) for write in writes]:
            done.result()


#: Every so many batches the remembered keys and the agent state are written whole; in between, only what is new.
WHOLE_EVERY = 50


def base_batch(batch_id: int) -> int:
    """The last batch before ``batch_id`` that holds a whole copy (0 is the first)."""
    return max(0, (batch_id - 1) // WHOLE_EVERY * WHOLE_EVERY)


def read_parts(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What a table held before ``batch_id``: the last whole copy and the parts since; with the column batch_id."""
    parts = [n for n in range(base_batch(batch_id), batch_id) if committed(spark, batch_path(path, n))]
    if not parts:
        return spark.createDataFrame([], f"{schema}, batch_id int")
    reader = spark.read.schema(f"{schema}, batch_id int").option("basePath", path)
    return reader.parquet(*[batch_path(path, n) for n in parts])


def decoded(batch: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Frames of a batch, and the payloads that are none; a batch of frames has no payloads."""
    if "value" not in batch.columns:
        return batch, None
    return decode_frames(batch)


def ingest_batch(batch: DataFrame, batch_id: int, out: str, options: IngestOptions) -> None:
    """Write everything one micro-batch of frames, or of JSON payloads (``value``), leads to; the acks last.

    Tables below ``out``: ``quarantine`` (payload and reasons, can be decoded again), ``frames``, ``agent_state`` and
    ``seen`` (what is new, now and then whole), ``alerts``, ``anomalies``, ``routed`` (with subscriptions), ``acks``. Each
    part is written once per batch, from the input and earlier parts, so a replay gives the same tables.
    """
    spark = batch.sparkSession
    cached: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    if "arrival_seq" not in batch.columns:
        # Order only matters inside a micro-batch, as every batch follows the ones before it.
        batch = batch.withColumn("arrival_seq", F.monotonically_increasing_id())
    # Used twice below: once for the keys, once for the whole rows. A micro-batch is not pruned to the columns
    # of each use, so without the cache its source would be read and decoded twice.
    source = keep(batch)
    frames, payloads = decoded(source)
    frames = keep(with_arrival_time(frames)) if payloads is not None else frames
    arrived = frames.withColumn("reasons", violations(options.strict))
    valid = arrived.filter(F.size("reasons") == 0)
    try:
        slot = time_bucket(F.col("received_at"), interval_micros(options.sweep))
        middle = F.percentile_approx(F.unix_micros("received_at"), 0.5, 1_000_000)
        # The sweeps' clock is the middle arrival: single rows stamped far ahead must not make everyone be forgotten.
        now, lowest = valid.agg(middle, F.min(slot)).first()
        lifetime = dead_after(options.ttl, options.sweep)
        seen = read_parts(spark, f"{out}/seen", SEEN_KEYS, batch_id)
        live = seen if lowest is None else seen.filter(F.col("bucket") >= lowest - lifetime)
        winners = keep(accepted(valid, options.ttl, options.sweep, live))
        checked = keep(detect(_marked(arrived, winners), options.detector))
        if checked.filter("not is_duplicate").count() > winners.count():  # a source that repeats arrival numbers
            checked = keep(detect(_marked(arrived, winners, ties=True), options.detector))
        marked = checked.filter(F.size("reasons") == 0).drop("reasons")
        fresh = marked.filter("not is_duplicate")

        whole = batch_id % WHOLE_EVERY == 0 and batch_id > 0
        keys = winners.select(KEY, "bucket")
        clock = None if now is None else now // 1000
        limits = {"clock_ms": F.lit(clock).cast("bigint"), "ttl_ms": F.lit(options.state_ttl_ms).cast("bigint")}
        states = last_arrival(state_rows(fresh)).withColumns(limits)
        if whole:
            # Twice the lifetime, so that slightly late arrivals still find their key.
            oldest = -(2**62) if now is None else now // interval_micros(options.sweep) - 2 * lifetime - 1
            keys = keys.unionByName(seen.filter(F.col("bucket") >= oldest).select(KEY, "bucket"))
            keys = keys.groupBy(KEY).agg(F.max("bucket").alias("bucket"))
            before = read_parts(spark, f"{out}/agent_state", STATE_PARTS, batch_id)
            later = states.withColumn("batch_id", F.lit(batch_id))
            states = _newest_state(before.unionByName(later))
        rejected = checked.filter(F.size("reasons") > 0).select(
            frame_json().alias("value"), "received_at", "arrival_seq", "traceparent", "reasons"
        )
        if payloads is not None:
            rejected = rejected.unionByName(with_arrival_time(payloads).select(*rejected.columns))
        alerts = alert_ops.build_alerts(fresh)
        tables = {
            "frames": batch_rows(fresh),
            "seen": keys,
            "agent_state": states,
            "quarantine": rejected,
            "anomalies": anomaly_messages(fresh),
            "alerts": alerts,
        }
        if options.subscriptions is not None:
            now_known = options.subscriptions
            now_known = spark.read.parquet(now_known) if isinstance(now_known, str) else now_known
            tables["routed"] = alert_ops.route_alerts(alerts, now_known)
        dated = {"frames": ("event_date",)}
        _write_all(
            spark,
            [
                partial(write_batch, rows, f"{out}/{name}", batch_id, dated.get(name, ()))
                for name, rows in tables.items()
            ],
        )
        write_batch(alert_ops.acks(marked), f"{out}/acks", batch_id)
        # Parts before a whole copy are done once the batch after it no longer needs them for a replay.
        if batch_id > WHOLE_EVERY and batch_id % WHOLE_EVERY == 1:
            for gone in range(base_batch(batch_id - 1), batch_id - 1):
                drop_snapshot(spark, f"{out}/seen", gone)
                drop_snapshot(spark, f"{out}/agent_state", gone)
    finally:
        for df in cached:
            df.unpersist()


def _marked(arrived: DataFrame, winners: DataFrame, ties: bool = False) -> DataFrame:
    """All rows with ``is_duplicate``; rows with reasons can be no winner."""
    valid, bad = arrived.filter(F.size("reasons") == 0), arrived.filter(F.size("reasons") > 0)
    return mark(valid, winners, ties).unionByName(bad.withColumn("is_duplicate", F.lit(True)))


def _newest_state(parts: DataFrame) -> DataFrame:
    """Last row per agent over the parts, without agents that have expired by the newest clock; with clock and limit."""
    clock, ttl_ms = parts.agg(F.max("clock_ms"), F.max_by("ttl_ms", "batch_id")).first()
    rows = last_arrival(parts.withColumn("arrival_seq", F.col("batch_id").cast("bigint")))
    if clock is not None:
        rows = rows.filter(~expired(F.timestamp_millis(F.lit(clock)), ttl_ms))
    return rows.withColumns({"clock_ms": F.lit(clock).cast("bigint"), "ttl_ms": F.lit(ttl_ms).cast("bigint")})


def _own(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Tie an output to its checkpoint: another one would number its batches anew and find them all written."""
    mine = spark.read.json(f"{checkpoint}/metadata").first()["id"]
    if not committed(spark, f"{out}/owner"):
        spark.createDataFrame([(mine,)], "id string").write.mode("overwrite").parquet(f"{out}/owner")
    owner = spark.read.parquet(f"{out}/owner").first()["id"]
    if owner != mine:
        raise ValueError(f"{out} belongs to another checkpoint; a new one needs a new output")


def run_ingest(
    frames: DataFrame, out: str, checkpoint: str, options: IngestOptions | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Start the ingest job over a stream of frames or of JSON payloads (a column ``value``); by default it ends when the
    input is used up."""
    chosen, owned = options or IngestOptions(), []

    def batch_done(batch: DataFrame, batch_id: int) -> None:
        if not owned:
            _own(batch.sparkSession, out, checkpoint)
            owned.append(True)
        ingest_batch(batch, batch_id, out, chosen)

    return (
        with_arrival_time(frames)
        .writeStream.foreachBatch(batch_done)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_state(spark: SparkSession, out: str) -> DataFrame:
    """The state table of an ingest job: the last row per agent that has not expired."""
    parts = read_parts(spark, f"{out}/agent_state", STATE_PARTS, latest_batch(spark, f"{out}/agent_state") + 1)
    return _newest_state(parts).drop("clock_ms", "ttl_ms")


def read_delivered(spark: SparkSession, out: str, cap: int = ALERT_BUFFER) -> tuple[DataFrame, DataFrame]:
    """``(delivered, overflow)`` of all routed alerts; the same however they came in batches."""
    return alert_ops.deliver(spark.read.parquet(f"{out}/routed").drop("batch_id"), cap)
