"""Redelivery of alerts that could not be decoded, over micro-batches and restarts.

Every batch tries its new payloads and the waiting ones whose time has come. What fails waits again, twice as long after every failure;
after ``most`` failures it is parked with its payload. The waiting payloads after each batch are a snapshot of their own, from
which the next batch goes on, and all tables are written once per batch: a batch that is replayed changes nothing, and a
payload that can be decoded after a repair is delivered once.

Tables below ``out``: ``alerts``, ``parked`` (value, attempt), ``waiting`` (value, attempt, due_ms; the newest batch holds).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.functions.keys import interval_micros, unix_ms
from metricloom.sources.alert_feed import decode_alerts
from metricloom.streaming.tables import drop_snapshot, read_snapshot, write_batch

WAITING = "value string, attempt int, due_ms bigint"
Decoder = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def deliver_batch(batch: DataFrame, batch_id: int, out: str, most: int, backoff: str, decode: Decoder = decode_alerts) -> None:
    """Deliver one batch (value, received_at; rows without a value only tell the time) and what is due."""
    spark = batch.sparkSession
    waiting = read_snapshot(spark, f"{out}/waiting", WAITING, batch_id - 1)
    fresh = batch.filter("value is not null").select("value", F.lit(0).alias("attempt"), F.lit(None).cast("bigint").alias("due_ms"))
    now = batch.agg(F.max(unix_ms(F.col("received_at")))).first()[0]
    due = waiting.filter(F.lit(False) if now is None else F.col("due_ms") <= now)
    later = waiting.filter(F.lit(True) if now is None else F.col("due_ms") > now)
    tried = fresh.unionByName(due).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        alerts, failed = decode(tried.select("value", "attempt"))
        first = interval_micros(backoff) // 1000
        wait = F.lit(now or 0) + F.call_function("shiftleft", F.lit(first).cast("bigint"), F.col("attempt") - 1)
        again = failed.filter(F.col("attempt") < most).select("value", "attempt", wait.alias("due_ms"))
        write_batch(alerts, f"{out}/alerts", batch_id)
        write_batch(failed.filter(F.col("attempt") >= most), f"{out}/parked", batch_id)
        write_batch(later.unionByName(again), f"{out}/waiting", batch_id)  # last: it completes the batch
        drop_snapshot(spark, f"{out}/waiting", batch_id - 2)
    finally:
        tried.unpersist()


def run_redelivery(
    payloads: DataFrame,
    out: str,
    checkpoint: str,
    most: int = 5,
    backoff: str = "1 minute",
    decode: Decoder = decode_alerts,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the job over a stream of payloads (value, received_at).

    The clock is the arrival times. Where payloads may stay away for longer than the backoff, union the stream with a slow rate
    source (null values): its rows let waiting payloads come up.
    """
    if not 1 <= most <= 40:
        raise ValueError("most must be from 1 to 40")
    return (
        payloads.writeStream.foreachBatch(lambda batch, n: deliver_batch(batch, n, out, most, backoff, decode))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
