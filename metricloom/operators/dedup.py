"""First-arrival de-duplication on ``idempotency_key``, global over agents and fleets.

``arrival_seq`` is a unique number that gives the order of arrival. No operator here brings all rows of a
key together: hot keys (an unset key is the usual one) shrink on the map side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from metricloom.functions.keys import interval_micros, time_bucket
from metricloom.schemas import DEDUP_SWEEP, DEDUP_TTL

KEY = "idempotency_key"
#: Slots of a block: long lists of accepted slots are never copied when one is added.
_BLOCK = 256


def dedup_batch(frames: DataFrame) -> DataFrame:
    """Keep the first arrival of each key.

    ``row_number() = 1`` is planned with a group limit below the exchange, so every task sends at most
    one row per key.
    """
    first = Window.partitionBy(KEY).orderBy("arrival_seq")
    return frames.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def mark_duplicates(frames: DataFrame) -> DataFrame:
    """All rows with ``is_duplicate``. The join back is on the unique ``arrival_seq``, so it cannot skew."""
    key = F.coalesce(KEY, F.lit("")).alias(KEY)
    return mark(frames, frames.groupBy(key).agg(F.min("arrival_seq").alias("arrival_seq")))


def mark(frames: DataFrame, winners: DataFrame, ties: bool = False) -> DataFrame:
    """Rows that are no winner (key, arrival_seq; each once) are duplicates. Only this narrow table meets the whole rows.

    With ``ties`` rows may share both key and arrival number; then one of them is the winner, at the cost of a sort of all rows.
    """
    first = winners.select(F.col(KEY).alias("_key"), "arrival_seq", F.lit(True).alias("_first"))
    rows = frames.withColumn("_key", F.coalesce(KEY, F.lit(""))).join(first, ["arrival_seq", "_key"], "left")
    again = F.col("_first").isNull()
    if ties:
        again = again | (F.row_number().over(Window.partitionBy("arrival_seq", "_key").orderBy("arrival_seq")) > 1)
    return rows.withColumn("is_duplicate", again).drop("_first", "_key")


def dead_after(ttl: str = DEDUP_TTL, sweep: str = DEDUP_SWEEP) -> int:
    """Number of sweep slots after its own in which a key is still remembered.

    Keys are forgotten only by a sweep, at multiples of ``sweep``, that finds them older than ``ttl``.
    A key first seen anywhere in slot ``b`` is removed by the sweep that starts slot
    ``b + ttl/sweep + 1``, so a remembered key lives between ``ttl`` and ``ttl + sweep``.
    """
    slots, rest = divmod(interval_micros(ttl), interval_micros(sweep))
    if rest:
        raise ValueError("ttl must be a multiple of sweep")
    return slots


def first_in_slots(frames: DataFrame, sweep: str = DEDUP_SWEEP) -> DataFrame:
    """First arrival per key and sweep slot: the only rows that can be accepted."""
    slot = time_bucket(F.col("received_at"), interval_micros(sweep)).alias("bucket")
    return frames.groupBy(KEY, slot).agg(F.min("arrival_seq").alias("arrival_seq"))


def accepted(
    frames: DataFrame, ttl: str = DEDUP_TTL, sweep: str = DEDUP_SWEEP, seen: DataFrame | None = None
) -> DataFrame:
    """``(idempotency_key, bucket, arrival_seq)`` of the accepted rows.

    ``seen`` (key, bucket) holds remembered acceptances from earlier input; the latest of a key counts. A null key is
    the unset key. A slot more than ``m`` slots after the one before it in its key is accepted whatever came before, so it begins a
    run of its own. Runs of one slot, which most are, need nothing else; the others are walked.
    """
    m = dead_after(ttl, sweep)
    firsts = first_in_slots(frames.withColumn(KEY, F.coalesce(KEY, F.lit(""))), sweep)
    if seen is not None:
        known = seen.groupBy(F.coalesce(KEY, F.lit("")).alias(KEY)).agg(F.max("bucket").alias("_last"))
        free = F.col("_last").isNull() | (F.col("bucket") > F.col("_last") + m)
        firsts = firsts.join(known, KEY, "left").filter(free).drop("_last")
    of_key = Window.partitionBy(KEY).orderBy("bucket")
    before, after = F.lag("bucket").over(of_key), F.lead("bucket").over(of_key)
    slots = firsts.withColumns({
        "_head": F.coalesce(F.col("bucket") > before + m, F.lit(True)),
        "_tail": F.coalesce(after > F.col("bucket") + m, F.lit(True)),
    })
    alone = slots.filter("_head and _tail").select(KEY, "bucket", "arrival_seq")
    run = F.sum(F.col("_head").cast("bigint")).over(of_key).alias("run")
    close = slots.select(KEY, "bucket", "arrival_seq", "_head", "_tail", run).filter("not (_head and _tail)")
    return alone.unionByName(_walked(close.drop("_head", "_tail"), m))


def _walked(slots: DataFrame, m: int) -> DataFrame:
    """Accepted slots of runs (key, run) of two slots or more, the first of which is accepted.

    A run is walked in blocks. Its first block is walked once; a later one, of which only very long runs have any, for
    each state it can begin with: free, or 1 to ``m`` slots after the last acceptance. A walk over the blocks then picks the
    state that holds. So the work is linear in the slots, whose number is bounded by the time span over the sweep.
    """
    of_run = Window.partitionBy(KEY, "run").orderBy("bucket")
    block = F.floor((F.row_number().over(of_run) - 1) / _BLOCK).alias("block")
    slot_list = F.sort_array(F.collect_list(F.struct("bucket", "arrival_seq"))).alias("_slots")
    blocks = slots.select("*", block).groupBy(KEY, "run", "block").agg(slot_list)
    empty = F.expr("cast(array() as array<struct<bucket: bigint, arrival_seq: bigint>>)")
    begin = F.get("_slots", F.lit(0))["bucket"]

    def walked(last):
        def step(state, slot):
            free = state["last"].isNull() | (slot["bucket"] > state["last"] + m)
            kept = F.concat(state["kept"], F.array(slot))
            return F.when(free, F.struct(slot["bucket"].alias("last"), kept.alias("kept"))).otherwise(state)

        return F.aggregate("_slots", F.struct(last.alias("last"), empty.alias("kept")), step)

    anew = walked(F.lit(None).cast("bigint"))
    walks = F.when(F.col("block") == 0, F.array(anew)).otherwise(F.array(anew, *[walked(begin - j) for j in range(1, m + 1)]))
    runs = blocks.select(KEY, "run", F.struct("block", begin.alias("begin"), walks.alias("walks")).alias("_b"))
    runs = runs.groupBy(KEY, "run").agg(F.collect_list("_b").alias("_blocks"))
    runs = runs.withColumn("_blocks", F.array_sort("_blocks", lambda a, b: (a["block"] - b["block"]).cast("int")))

    def follow(state, b):
        past = b["begin"] - state["last"]
        at = F.when(state["last"].isNull() | (past > m), F.lit(0)).otherwise(past.cast("int"))
        return F.struct(F.get(b["walks"], at)["last"].alias("last"), F.concat(state["at"], F.array(at)).alias("at"))

    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.expr("cast(array() as array<int>)").alias("at"))
    at = F.aggregate("_blocks", start, follow, lambda state: state["at"])
    kept = F.flatten(F.zip_with("_blocks", at, lambda b, i: F.get(b["walks"], i)["kept"]))
    return runs.select(KEY, F.explode(kept).alias("_k")).select(KEY, "_k.bucket", "_k.arrival_seq")


def mark_duplicates_ttl(
    frames: DataFrame, ttl: str = DEDUP_TTL, sweep: str = DEDUP_SWEEP, seen: DataFrame | None = None
) -> DataFrame:
    """All rows with ``is_duplicate``, keys being forgotten as described in :func:`dead_after`."""
    return mark(frames, accepted(frames, ttl, sweep, seen))


def dedup_batch_ttl(frames: DataFrame, ttl: str = DEDUP_TTL, sweep: str = DEDUP_SWEEP) -> DataFrame:
    """Keep the accepted rows only."""
    winners = accepted(frames, ttl, sweep).select(F.col(KEY).alias("_key"), F.col("arrival_seq").alias("_seq"))
    same = (frames["arrival_seq"] == winners["_seq"]) & (F.coalesce(frames[KEY], F.lit("")) == winners["_key"])
    return frames.join(winners, same, "left_semi")


def dedup_stream(frames: DataFrame, ttl: str = DEDUP_TTL, time_col: str = "received_at") -> DataFrame:
    """Streaming form on Spark's own state: one row per key while the watermark has not passed it.

    Which of several copies inside one micro-batch survives is not defined; the ingest job
    (:mod:`metricloom.streaming.ingest`) marks duplicates exactly.
    """
    return frames.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark([KEY])
