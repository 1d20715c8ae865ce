"""Alert routing with subscriptions that come and go while the job runs.

Alerts and subscription events (someone subscribes to an agent, or ends it) are one stream in order of time. What arrives is
held in keyed state until the watermark has passed its time; then an alert goes to the registration in force, as
:func:`metricloom.operators.alerts.with_subscriber` has it in batch: the newest subscription replaces older ones, any end removes
it. A restart is not needed for a new subscriber, and it does not matter in which micro-batch an event came, as long
as it is not behind the watermark.

An agent's alerts are dealt to ``salts`` keys, each of which gets all events of the agent: events are few, alerts need not be. These keys
are dealt to ``shards`` in turn, as a call into the state store costs about as much as a hundred rows do: a shard holds its rows in packed
pieces, each with one timer, and looks the registrations up for all its rows at once. Its rows of a micro-batch meet in one task; more
shards make them fewer. Both numbers are fixed for the life of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from metricloom.streaming.keyed_state import SHARDS

ROUTED = "payload string, subscribed_us bigint"
#: Order of what happens at the same time: an end, a subscription, an alert.
END, BEGIN, ALERT = 0, 1, 2
#: Rows of a held piece at most.
PIECE = 20_000
_ROWS = pa.schema([("agent_id", pa.string()), ("at", pa.int64()), ("kind", pa.int32()), ("payload", pa.string())])
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(pa.Table.from_pandas(rows, _ROWS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


def route(current: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The alerts among ``rows`` that reach a subscriber, and the registrations in force after them; ``current`` has those before."""
    every = pd.concat([current, rows], ignore_index=True) if len(current) else rows
    agent = pd.factorize(every["agent_id"], use_na_sentinel=False)[0]
    at, kind = every["at"].to_numpy(np.int64), every["kind"].to_numpy(np.int64)
    order = np.lexsort((kind, at, np.arange(len(every)) >= len(current), agent))
    agent, at, kind = agent[order], at[order], kind[order]
    last = np.maximum.accumulate(np.where(kind != ALERT, np.arange(len(order)), -1))
    subscribed = (last >= 0) & (agent[last] == agent) & (kind[last] == BEGIN)
    sent = subscribed & (kind == ALERT)
    routed = pd.DataFrame({"payload": every["payload"].to_numpy(object)[order[sent]], "subscribed_us": at[last[sent]]})
    ends = subscribed & np.append(agent[1:] != agent[:-1], True)
    return routed, every.iloc[order[last[ends]]]


class LiveRoutes(StatefulProcessor):
    """Holds rows until their time has passed, and the registrations in force; for the agents of a shard."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "first_us bigint, number int", "rows binary")
        self.current = handle.getValueState("current", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self._pass([part[_ROWS.names] for part in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._pass([], timerValues.getCurrentWatermarkInMs())

    def _pass(self, parts: list[pd.DataFrame], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Let go of everything before the watermark, in order of time; pieces that begin later are not opened."""
        pieces = [tuple(key) for key in self.held.keys()] if self.held.exists() else []
        for key in [key for key in pieces if key[0] < watermark_ms * 1000]:
            parts.append(unpack(self.held.getValue(key)[0]))
            self.held.removeKey(key)
            pieces.remove(key)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        past = rows["at"] < watermark_ms * 1000
        self._hold(rows[~past], pieces)
        rows = rows[past]
        if len(rows):
            current = unpack(self.current.get()[0]) if self.current.exists() else pd.DataFrame(columns=_ROWS.names)
            routed, after = route(current, rows)
            if (rows["kind"] != ALERT).any():
                self.current.update((pack(after),))
            if len(routed):
                yield routed

    def _hold(self, rows: pd.DataFrame, pieces: list[tuple[int, int]]) -> None:
        rows = rows.sort_values("at", kind="stable")
        for start in range(0, len(rows), PIECE):
            piece = rows.iloc[start : start + PIECE]
            first = int(piece["at"].iloc[0])
            key = (first, 1 + max((number for at, number in pieces if at == first), default=-1))
            pieces.append(key)
            self.held.updateValue(key, (pack(piece),))
            self.handle.registerTimer(first // 1000 + 1)

    def close(self) -> None:
        pass


def subscription_events(subscriptions: DataFrame) -> DataFrame:
    """Events (agent_id, at, kind) of a table or stream of subscriptions, with ends if it has ``unsubscribed_at``."""
    begin = F.struct(F.col("subscribed_at").alias("at"), F.lit(BEGIN).alias("kind"))
    events = F.array(begin)
    if "unsubscribed_at" in subscriptions.columns:
        end = F.struct(F.col("unsubscribed_at").alias("at"), F.lit(END).alias("kind"))
        events = F.array(begin, end)
    return subscriptions.select("agent_id", F.inline(events)).filter("at is not null")


def route_live(alerts: DataFrame, events: DataFrame, delay: str = "0 seconds", salts: int = 8, shards: int = SHARDS) -> DataFrame:
    """Stream of the alerts that reach a subscriber, with ``subscribed_at``; ``events`` is a stream of (agent_id, at, kind).

    Rows that come more than ``delay`` after later ones, of either stream, are dropped, and so are rows without a time. Start the query
    inside :func:`metricloom.streaming.keyed_state.rocksdb`.
    """

    def shard(salt: Column) -> Column:
        return F.pmod(F.pmod(F.xxhash64("agent_id"), F.lit(shards)) + salt, F.lit(shards)).cast("int").alias("shard")

    agent = F.col("agent_id").cast("string").alias("agent_id")
    payload = F.to_json(F.struct(*alerts.columns), _MICROS).alias("payload")
    salt = F.pmod(F.xxhash64("alert_id"), F.lit(salts))
    ours = alerts.select(shard(salt), agent, F.col("triggered_at").alias("at"), F.lit(ALERT).alias("kind"), payload)
    every = events.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    theirs = every.select(shard(F.col("salt")), agent, "at", F.col("kind").cast("int").alias("kind"), F.lit(None).cast("string").alias("payload"))
    rows = ours.unionByName(theirs).filter("at is not null").withColumnRenamed("at", "event_time").withWatermark("event_time", delay)
    rows = rows.withColumn("at", F.unix_micros("event_time"))
    routed = rows.groupBy("shard").transformWithStateInPandas(LiveRoutes(), ROUTED, "append", "eventTime")
    alert = F.from_json("payload", alerts.schema, _MICROS).alias("a")
    return routed.select(alert, F.timestamp_micros("subscribed_us").alias("subscribed_at")).select("a.*", "subscribed_at")
