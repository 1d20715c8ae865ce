"""Live routing against the batch form, whatever micro-batch an event comes in, and subscriptions read per batch."""

import random

import pandas as pd

from conftest import at, frame

from metricloom.operators.alerts import route_alerts
from metricloom.streaming import ingest, keyed_state as ks, live_routing as lr

ALERTS = "alert_id string, agent_id string, triggered_at timestamp, severity int, note string"
EVENTS = "agent_id string, at timestamp, kind int"


def streamed(spark, tmp_path, alerts, events, delay="0 seconds"):
    """Lists of micro-batches of both streams, run to the end."""
    for name, kinds, batches in (("alerts", ALERTS, alerts), ("events", EVENTS, events)):
        for rows in batches:
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = {
        n: spark.readStream.schema(k).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, k in (("alerts", ALERTS), ("events", EVENTS))
    }
    with ks.rocksdb(spark):
        rows = lr.route_live(read["alerts"], read["events"], delay, salts=3)
        writer = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return {(r.alert_id, r.agent_id, r.triggered_at, r.note, r.subscribed_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_events_between_batches_route_as_in_batch(spark, tmp_path):
    rng, alerts, events, subscriptions = random.Random(21), [], [], []
    for i in range(150):
        agent = "hot" if rng.random() < 0.4 else f"a{rng.randrange(5)}"
        alerts.append((f"x{i}", agent, at(round(rng.uniform(0, 4000), 6)), 3, None if i % 3 else 'says "so"'))
    for agent in ("hot", "a0", "a1", "a2"):
        for _ in range(4):
            begin = round(rng.uniform(0, 3500), 6)
            end = round(begin + rng.uniform(1, 900), 6) if rng.random() < 0.7 else None
            subscriptions.append((agent, at(begin), at(end) if end else None))
            events.append((agent, at(begin), lr.BEGIN))
            if end:
                events.append((agent, at(end), lr.END))
    last = [("end", "nobody", at(9000), 0, None)]  # lets the watermark pass everything before it
    cut = lambda rows, place: [[r for r in rows if 1000 * k <= (r[place] - at(0)).total_seconds() < 1000 * (k + 1)] for k in range(5)]
    found = streamed(spark, tmp_path, [*cut(alerts, 2), last], cut(events, 1))
    table = spark.createDataFrame(subscriptions, "agent_id string, subscribed_at timestamp, unsubscribed_at timestamp")
    batch = route_alerts(spark.createDataFrame(alerts, ALERTS), table).collect()
    assert found == {(r.alert_id, r.agent_id, r.triggered_at, r.note, r.subscribed_at) for r in batch}
    assert 20 < len(found) < 150


def test_same_time_and_rows_within_the_delay(spark, tmp_path):
    """An event that comes a batch late, but within the delay, still holds; at one time an end precedes a begin, and both an alert."""
    alerts = [[("1", "a", at(10), 1, ""), ("2", "a", at(20), 1, "")], [("3", "a", at(30), 1, "")], [("9", "z", at(500), 1, "")]]
    events = [[("a", at(30), lr.BEGIN), ("a", at(30), lr.END)], [("a", at(15), lr.BEGIN)]]
    found = streamed(spark, tmp_path, alerts, events, "60 seconds")
    assert {(r[0], r[4]) for r in found} == {("2", at(15)), ("3", at(30))}


def test_events_of_a_table(spark):
    rows = [("a", at(1), at(2)), ("b", at(3), None)]
    table = spark.createDataFrame(rows, "agent_id string, subscribed_at timestamp, unsubscribed_at timestamp")
    events = {tuple(r) for r in lr.subscription_events(table).collect()}
    assert events == {("a", at(1), lr.BEGIN), ("a", at(2), lr.END), ("b", at(3), lr.BEGIN)}
    assert lr.subscription_events(table.drop("unsubscribed_at")).count() == 2


def test_ingest_sees_who_subscribes_later(spark, frames, tmp_path):
    """The job runs on with one checkpoint; between its batches someone subscribes."""
    path, out = str(tmp_path / "subs"), str(tmp_path / "out")
    kinds = "agent_id string, fleet_id string, subscribed_at timestamp"
    spark.createDataFrame([("a", "f1", at(0))], kinds).write.parquet(path)
    options = ingest.IngestOptions(subscriptions=path)
    for batch, agents in enumerate((["a", "b"], ["a", "b"])):
        rows = [frame(agent=a, cpu=99.0, key=f"{a}{batch}", when=100.0 * batch, received=100.0 * batch + 1) for a in agents]
        ingest.ingest_batch(frames(*rows), batch, out, options)
        spark.createDataFrame([("b", "f1", at(50))], kinds).write.mode("append").parquet(path)
    routed = spark.read.parquet(f"{out}/routed")
    assert {(r.agent_id, r.batch_id) for r in routed.collect()} == {("a", 0), ("a", 1), ("b", 1)}


class Store(dict):
    """A state variable and its handle, in memory."""

    def exists(self):
        return bool(self)

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def getMapState(self, *_):
        self.pieces = Store()
        return self.pieces

    def getValueState(self, *_):
        return Store()

    def registerTimer(self, at_ms):
        self[at_ms] = None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def one_by_one(rows):
    current, out = {}, set()
    for agent, when, kind, payload in sorted(rows, key=lambda r: r[1:3]):
        if kind != lr.ALERT:
            current[agent] = when if kind == lr.BEGIN else None
        elif current.get(agent) is not None:
            out.add((payload, current[agent]))
    return out


def test_a_shard_of_many_agents_routes_as_one_by_one(monkeypatch):
    """Rows come in disorder, in pieces of three, with a null agent and equal times; a piece that begins later stays closed."""
    monkeypatch.setattr(lr, "PIECE", 3)
    rng, rows = random.Random(4), []
    for i in range(400):
        kind = rng.choice((lr.END, lr.BEGIN, lr.ALERT, lr.ALERT))
        rows.append((rng.choice(("a", "b", "c", None)), rng.randrange(120) * 500, kind, f"p{i}" if kind == lr.ALERT else None))
    routes, handle, out = lr.LiveRoutes(), Store(), []
    routes.init(handle)
    for batch in range(6):  # a row waits for two batches at most
        mine = [r for r in rows if r[1] // 10_000 == batch]
        parts = [pd.DataFrame(mine[i::2], columns=["agent_id", "at", "kind", "payload"]) for i in range(2)]
        out += [r for part in routes.handleInputRows((0,), iter(parts), Clock(10 * batch - 5)) for r in part.itertuples(index=False)]
        assert handle.pieces and all(key[0] >= (10 * batch - 5) * 1000 for key in handle.pieces)
        assert sum(len(lr.unpack(packed)) for packed, in handle.pieces.values()) < 2 * len(mine)
    timers = len(handle)
    out += [r for part in routes.handleExpiredTimer((0,), Clock(100), None) for r in part.itertuples(index=False)]
    assert not handle.pieces and len(handle) == timers
    assert {tuple(r) for r in out} == one_by_one(rows) and len(out) == len({r[0] for r in out}) > 30
    assert list(routes.handleExpiredTimer((0,), Clock(100), None)) == []


def test_state_is_by_shard_not_by_agent(spark, tmp_path):
    agents = [f"a{i}" for i in range(150)]
    spark.createDataFrame([(a, at(1), lr.BEGIN) for a in agents], EVENTS).coalesce(1).write.parquet(str(tmp_path / "events"))
    rows = [(f"x{a}", a, at(2), 1, "") for a in agents] + [("end", "nobody", at(90), 0, None), ("none", "a1", None, 1, "")]
    spark.createDataFrame(rows, ALERTS).coalesce(1).write.parquet(str(tmp_path / "alerts"))
    alerts, events = (spark.readStream.schema(k).parquet(str(tmp_path / n)) for n, k in (("alerts", ALERTS), ("events", EVENTS)))
    with ks.rocksdb(spark):
        routed = lr.route_live(alerts, events, salts=2, shards=3).writeStream.format("parquet")
        query = routed.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(agents)
    kept = [operator["numRowsTotal"] for progress in query.recentProgress for operator in progress["stateOperators"]]
    assert 0 < max(kept) <= 20
