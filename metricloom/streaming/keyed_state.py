"""State per key with timers: forgetting idempotency keys at their sweep, evicting agents when they are due.

Both jobs run on ``transformWithState`` with the RocksDB state store and event-time timers: what a key needs is kept in
state and goes when the watermark passes the timer, not when a table is next read. State may begin with a table that another job
left. Rows are thinned before the shuffle, per batch of rows and time slot, so a hot key sends a few rows per slot.

Keys are dealt to ``shards`` by their hash. A call into the state store costs about as much as a hundred rows do, so the state of a
shard is a map from the time at which keys are due to the keys, and has one timer per such time, not one per key. What is due before
the newest arrival of its shard (less ``delay``) is settled at once: no row that is still let in could change it. A shard's rows of a
micro-batch meet in one task; more ``shards`` make them fewer. The number is fixed for the life of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from metricloom.functions.keys import interval_micros, time_bucket, unix_ms
from metricloom.functions.metrics import cpu_or_zero
from metricloom.operators.dedup import KEY, dead_after
from metricloom.operators.state import STATE_KEY
from metricloom.schemas import DEDUP_SWEEP, DEDUP_TTL, STATE_SWEEP, STATE_TTL_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shards that keys are dealt to.
SHARDS = 256
WINNERS = f"{KEY} string, bucket bigint, arrival_seq bigint"
STATE_OF_AGENT = "fleet_id: string, agent_id: string, cpu: double, last_seen_ms: bigint, status: int"
EVICTIONS = "fleet_id string, agent_id string, cpu double, last_seen_ms bigint, status int, evicted_ms bigint"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the RocksDB state store, which keyed processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class SweptKeys(StatefulProcessor):
    """Accepts a key's first arrival, and the next one after a sweep has forgotten the key; for the keys of a shard."""

    def __init__(self, lifetime: int, sweep_ms: int, delay_ms: int = 0):
        self.lifetime, self.sweep_ms, self.delay_ms = lifetime, sweep_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getMapState("kept", "bucket bigint", "keys array<string>")

    def _due(self, bucket: int) -> int:
        return (bucket + self.lifetime + 1) * self.sweep_ms

    def _read(self) -> tuple[dict[int, list[str]], dict[str, int]]:
        """What is kept by slot, and the last slot of each key."""
        slots = {row[0]: list(keys[0]) for row, keys in self.kept.iterator()} if self.kept.exists() else {}
        return slots, {key: bucket for bucket in sorted(slots) for key in slots[bucket]}

    def _add(self, slots: dict[int, list[str]], fresh: dict[int, list[str]]) -> None:
        for bucket, keys in fresh.items():
            if bucket not in slots:
                self.handle.registerTimer(self._due(bucket))
            self.kept.updateValue((bucket,), (slots.get(bucket, []) + keys,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        slots, last = self._read()
        fresh: dict[int, list[str]] = {}
        for name, bucket in initialState.groupby(KEY)["bucket"].max().items():
            if name not in last or last[name] < bucket:
                fresh.setdefault(int(bucket), []).append(name)
        self._add(slots, fresh)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[tuple[str, int], int] = {}  # one entry per key and slot of the micro-batch
        newest = -(2**62)
        for part in rows:
            newest = max(newest, int(part["received_ms"].max()))
            known = part["arrival_seq"].notna()
            part = pd.concat([part[known], part[~known]])  # an arrival without a number is first only where no other is
            for name, bucket, seq in zip(part[KEY].tolist(), part["bucket"].tolist(), part["arrival_seq"].tolist()):
                before = first.get((name, bucket))
                if before is None or seq < before:
                    first[name, bucket] = seq
        slots, last = self._read()
        accepted, fresh = [], {}
        for name, bucket in sorted(first):
            if name not in last or bucket > last[name] + self.lifetime:
                last[name] = bucket
                accepted.append((name, bucket, first[name, bucket]))
                if self._due(bucket) > newest - self.delay_ms:
                    fresh.setdefault(bucket, []).append(name)
        self._add(slots, fresh)
        if accepted:
            yield pd.DataFrame(accepted, columns=[KEY, "bucket", "arrival_seq"]).astype({"arrival_seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.removeKey((expiredTimerInfo.getExpiryTimeInMs() // self.sweep_ms - self.lifetime - 1,))
        return iter(())

    def close(self) -> None:
        pass


def accepted_stream(
    frames: DataFrame, ttl: str = DEDUP_TTL, sweep: str = DEDUP_SWEEP, delay: str = "0 seconds", seen: DataFrame | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """Stream of the accepted arrivals (idempotency_key, bucket, arrival_seq) of a stream of frames.

    The answer is that of :func:`metricloom.operators.dedup.accepted` if rows come in the order of their sweep slots, or up to
    ``delay`` after later ones; rows behind the watermark are dropped. ``seen`` (key, bucket) is what is remembered at the start.
    A null key is the unset key; rows without an arrival time are in no slot and dropped. Start the query inside :func:`rocksdb`.
    """
    slot = time_bucket(F.col("received_at"), interval_micros(sweep)).alias("bucket")
    narrow = frames.filter("received_at is not null").select(F.coalesce(KEY, F.lit("")).alias(KEY), slot, "arrival_seq", "received_at")

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                groups = pa.Table.from_batches([batch]).group_by([KEY, "bucket"])
                least = groups.aggregate([("arrival_seq", "min"), ("received_at", "max")])
                yield from least.rename_columns([KEY, "bucket", "arrival_seq", "received_at"]).to_batches()

    shard = F.pmod(F.xxhash64(KEY), F.lit(shards)).cast("int").alias("shard")
    rows = narrow.mapInArrow(thinned, f"{WINNERS}, received_at timestamp").withWatermark("received_at", delay)
    rows = rows.select(shard, "*", unix_ms(F.col("received_at")).alias("received_ms"))
    begin = None
    if seen is not None:
        begin = seen.select(F.coalesce(KEY, F.lit("")).alias(KEY), "bucket").select(shard, KEY, "bucket").groupBy("shard")
    processor = SweptKeys(dead_after(ttl, sweep), interval_micros(sweep) // 1000, interval_micros(delay) // 1000)
    return rows.groupBy("shard").transformWithStateInPandas(processor, WINNERS, "append", "eventTime", initialState=begin)


class AgentClock(StatefulProcessor):
    """Keeps the last arrival of an agent until the first sweep that finds it older than the limit; for the agents of a shard."""

    def __init__(self, ttl_ms: int, sweep_ms: int, delay_ms: int = 0):
        self.ttl_ms, self.sweep_ms, self.delay_ms = ttl_ms, sweep_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "due_ms bigint", f"agents array<struct<{STATE_OF_AGENT}>>")

    def _due(self, slot: int, last_seen_ms: int) -> int:
        """The first sweep after the arrival's slot at which the state is strictly older than the limit."""
        return max(slot + 1, (last_seen_ms + self.ttl_ms) // self.sweep_ms + 1) * self.sweep_ms

    def _read(self) -> dict[int, list[tuple]]:
        """States (agent, cpu, last seen, status) by the time they are due."""
        if not self.states.exists():
            return {}
        return {row[0]: [tuple(state) for state in agents[0]] for row, agents in self.states.iterator()}

    def _keep(self, before: dict[int, list[tuple]], now: dict[tuple, tuple]) -> None:
        after: dict[int, list[tuple]] = {}
        for agent, (*state, due) in now.items():
            after.setdefault(due, []).append((*agent, *state))
        for due in before.keys() - after.keys():
            self.states.removeKey((due,))
            self.handle.deleteTimer(due)
        for due, agents in after.items():
            if due not in before:
                self.handle.registerTimer(due)
            if agents != before.get(due):
                self.states.updateValue((due,), (agents,))

    def _gone(self, states: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(states, columns=[c.split()[0] for c in EVICTIONS.split(", ")])
        return rows.astype({"status": "int32"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        before = self._read()
        now = _by_agent(before)
        for fleet, agent, cpu, seen, status in _tuples(initialState.sort_values("last_seen_ms"), "cpu", "last_seen_ms", "status"):
            now[fleet, agent] = (cpu, seen, status, self._due(seen // self.sweep_ms, seen))
        self._keep(before, now)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrivals = pd.concat(rows).sort_values(["received_ms", "arrival_seq"])
        before = self._read()
        now, gone = _by_agent(before), []
        for fleet, agent, slot, cpu, seen, status in _tuples(arrivals, "slot", "cpu", "last_seen_ms", "status"):
            state = now.get((fleet, agent))
            if state is not None and slot * self.sweep_ms >= state[3]:
                gone.append((fleet, agent, *state))
            now[fleet, agent] = (cpu, seen, status, self._due(slot, seen))
        settled = int(arrivals["received_ms"].iloc[-1]) - self.delay_ms
        gone += [(*agent, *state) for agent, state in now.items() if state[3] < settled]
        self._keep(before, {agent: state for agent, state in now.items() if state[3] >= settled})
        if gone:
            yield self._gone(gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        states = self.states.getValue((due,))[0]
        self.states.removeKey((due,))
        yield self._gone([(*state, due) for state in states])

    def close(self) -> None:
        pass


def _by_agent(states: dict[int, list[tuple]]) -> dict[tuple, tuple]:
    return {state[:2]: (*state[2:], due) for due, agents in states.items() for state in agents}


def _tuples(rows: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    """The agent and ``columns`` of each row, as plain values."""
    return zip(*(rows[name].tolist() for name in (*STATE_KEY, *columns)))


def evictions_stream(
    detected: DataFrame, ttl_ms: int = STATE_TTL_MS, sweep: str = STATE_SWEEP, delay: str = "0 seconds", state: DataFrame | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """Stream of the agent states given up: fleet_id, agent_id, the last arrival's cpu, last_seen_ms and status, and evicted_ms.

    A sweep at every multiple of ``sweep`` gives up the states that were collected more than ``ttl_ms`` before it, as
    ``expired`` has it. So only the last arrival per sweep slot matters, and no other leaves its task. Frames without a
    collection time, or without an arrival time, leave the state as it is. ``state`` is a state table to begin with. Start the query inside :func:`rocksdb`.
    """
    slot, seen = time_bucket(F.col("received_at"), interval_micros(sweep)), unix_ms(F.col("collected_at"))
    narrow = detected.filter("collected_at is not null and received_at is not null").select(
        *STATE_KEY, "arrival_seq", "received_at", unix_ms(F.col("received_at")).alias("received_ms"), slot.alias("slot"),
        cpu_or_zero().alias("cpu"), seen.alias("last_seen_ms"), F.col("severity").cast("int").alias("status"),
    )

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas().sort_values(["received_ms", "arrival_seq"])
            last = rows.drop_duplicates([*STATE_KEY, "slot"], keep="last")
            yield pa.RecordBatch.from_pandas(last, schema=batch.schema, preserve_index=False)

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in narrow.dtypes)
    shard = F.pmod(F.xxhash64(*STATE_KEY), F.lit(shards)).cast("int").alias("shard")
    thin = narrow.mapInArrow(thinned, kinds).withWatermark("received_at", delay).select(shard, "*")
    begin = None if state is None else state.select(shard, *STATE_KEY, "cpu", "last_seen_ms", "status").groupBy("shard")
    processor = AgentClock(ttl_ms, interval_micros(sweep) // 1000, interval_micros(delay) // 1000)
    return thin.groupBy("shard").transformWithStateInPandas(processor, EVICTIONS, "append", "eventTime", initialState=begin)
