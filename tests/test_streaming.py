import json
import random

import pytest
from conftest import at, frame, ms

from metricloom.operators.dedup import dedup_stream, mark_duplicates_ttl
from metricloom.operators.detect import anomaly_messages, detect
from metricloom.operators.state import state_stream
from metricloom.schemas import frame_schema
from metricloom.sources.frames_json import decode_frames
from metricloom.sources.store import read_store
from metricloom.streaming import fleet_windows as sw
from metricloom.streaming import ingest as ing
from metricloom.streaming.tables import latest_batch


def traffic(n=400, seed=5):
    """Frames in arrival order, with duplicates, a hot key, broken ids and hot agents."""
    rng, rows = random.Random(seed), []
    for seq in range(n):
        when = seq * 20.0
        key = "" if rng.random() < 0.2 else f"k{rng.randrange(150)}"
        agent = "" if rng.random() < 0.03 else "hot" if rng.random() < 0.33 else f"a{rng.randrange(12)}"
        cpu = None if rng.random() < 0.1 else round(rng.uniform(0, 110), 3)
        rows.append(frame(agent=agent, fleet=f"f{rng.randrange(3)}", when=when, key=key, cpu=cpu, seq=seq, received=when))
    return rows


def source(spark, frames, path, parts):
    """One parquet file per part, read one file per micro-batch in order."""
    import time

    for i, part in enumerate(parts):
        frames(*part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.1)  # files are taken in the order of their modification times
    return spark.readStream.schema(frame_schema("bigint")).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(spark, frames, path, parts, options=None):
    stream = source(spark, frames, path, parts)
    query = ing.run_ingest(stream, f"{path}/out", f"{path}/ckpt", options)
    query.awaitTermination()
    return query


def ack_rows(df):
    return sorted((r.idempotency_key, r.server_received_at is None) for r in df.collect())


def test_stream_equals_batch(spark, frames, tmp_path):
    rows = traffic()
    parts = [rows[i : i + 100] for i in range(0, len(rows), 100)]
    path = str(tmp_path)
    run(spark, frames, path, parts, ing.IngestOptions(state_ttl_ms=10**9))
    assert latest_batch(spark, f"{path}/out/agent_state") == 3

    valid = frames(*[r for r in rows if r[0]])
    marked = detect(mark_duplicates_ttl(valid)).collect()
    fresh = [r for r in marked if not r.is_duplicate]
    acks = spark.read.parquet(f"{path}/out/acks")
    assert ack_rows(acks) == sorted((r.idempotency_key, r.is_duplicate) for r in marked)
    assert spark.read.parquet(f"{path}/out/quarantine").count() == len([r for r in rows if not r[0]])
    stored = {(r.agent_id, r.unix_ms) for r in read_store(spark, f"{path}/out/frames").collect()}
    assert stored == {(r.agent_id, ms(r.collected_at)) for r in fresh}
    alerts = spark.read.parquet(f"{path}/out/alerts").collect()
    assert len(alerts) == len({a.alert_id for a in alerts}) == sum(r.is_anomaly for r in fresh)
    last = {}
    for r in sorted(fresh, key=lambda r: r.arrival_seq):
        last[r.fleet_id, r.agent_id] = (r.system.cpu_utilization_pct if r.system else 0.0, ms(r.collected_at), r.severity)
    assert {tuple(r)[:2]: tuple(r)[2:] for r in ing.read_state(spark, f"{path}/out").collect()} == last
    # the windows of the stream of anomalies, up to the watermark
    messages = sw.stream_messages(spark, f"{path}/out/anomalies")
    sw.run_windows(messages, f"{path}/windows", f"{path}/ckpt2", delay="1 minute").awaitTermination()
    got = {(r.fleet_id, r.window_start): r.anomaly_count for r in sw.read_windows(spark, f"{path}/windows").collect()}
    newest = max(r.collected_at for r in fresh if r.is_anomaly)
    expected = {}
    for r in fresh:
        if r.is_anomaly:
            start = r.collected_at.replace(second=0)
            expected[r.fleet_id, start] = expected.get((r.fleet_id, start), 0) + 1
    closed = {k: v for k, v in expected.items() if (newest - k[1]).total_seconds() >= 120}
    assert closed and got == closed


def test_second_run_and_replay_add_nothing(spark, frames, tmp_path):
    rows, path = traffic(60, seed=9), str(tmp_path)
    run(spark, frames, path, [rows[:30], rows[30:]])
    tables = ["acks", "alerts", "anomalies", "frames", "quarantine"]
    before = {t: spark.read.parquet(f"{path}/out/{t}").count() for t in tables}
    stream = spark.readStream.schema(frame_schema("bigint")).parquet(f"{path}/in")
    ing.run_ingest(stream, f"{path}/out", f"{path}/ckpt").awaitTermination()
    # a lost commit: the same micro-batch is given again, once with finished and once with half-written tables
    replayed = frames(*rows[30:])
    ing.ingest_batch(replayed, 1, f"{path}/out", ing.IngestOptions())
    (tmp_path / "out" / "acks" / "batch_id=1" / "_SUCCESS").unlink()
    (tmp_path / "out" / "alerts" / "batch_id=1" / "_SUCCESS").unlink()
    ing.ingest_batch(replayed, 1, f"{path}/out", ing.IngestOptions())
    assert before == {t: spark.read.parquet(f"{path}/out/{t}").count() for t in tables}


def test_keys_are_forgotten_across_batches(spark, frames, tmp_path):
    parts = [
        [frame(key="k", received=0, when=0, seq=1)],
        [frame(key="k", received=300, when=300, seq=2), frame(key="m", received=301, when=301, seq=3)],
        [frame(key="k", received=1000, when=1000, seq=4), frame(key="m", received=1000, when=1000, seq=5)],
    ]
    run(spark, frames, str(tmp_path), parts)
    acks = spark.read.parquet(f"{tmp_path}/out/acks").collect()
    got = sorted((r.idempotency_key, r.server_received_at) for r in acks if r.server_received_at)
    assert got == [("k", at(0)), ("k", at(1000)), ("m", at(301))]
    seen = [spark.read.parquet(f"{tmp_path}/out/seen/batch_id={n}").count() for n in range(3)]
    assert seen == [1, 1, 1]  # each batch adds what it accepted


def test_state_eviction_in_the_job(spark, frames, tmp_path):
    parts = [[frame(agent="old", when=0.0)], [frame(agent="new", when=3601.0)]]
    run(spark, frames, str(tmp_path), parts)
    assert [r.agent_id for r in ing.read_state(spark, f"{tmp_path}/out").collect()] == ["new"]


def test_delivery_in_the_job(spark, frames, tmp_path):
    subs = spark.createDataFrame([("a1", "f1", at(-5))], "agent_id string, fleet_id string, subscribed_at timestamp")
    rows = [frame(when=float(i), cpu=99.0) for i in range(12)] + [frame(agent="a2", when=1.0, cpu=99.0)]
    run(spark, frames, str(tmp_path), [rows], ing.IngestOptions(subscriptions=subs))
    delivered, overflow = ing.read_delivered(spark, f"{tmp_path}/out")
    assert (delivered.count(), overflow.count()) == (10, 2)
    # the same alerts, one batch each
    run(spark, frames, f"{tmp_path}/many", [[r] for r in rows], ing.IngestOptions(subscriptions=subs))
    assert sorted(r.alert_id for r in ing.read_delivered(spark, f"{tmp_path}/many/out")[0].collect()) == sorted(
        r.alert_id for r in delivered.collect()
    )
    assert spark.read.parquet(f"{tmp_path}/out/alerts").count() == 13


def test_json_lines_without_arrival_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"agent_id": "a", "fleetId": "f", "idempotency_key": k, "collected_at": "2024-03-01T10:00:00Z"} for k in "xyx"]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    raw = spark.readStream.text(f"{tmp_path}/in")
    ing.run_ingest(raw, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    acks = spark.read.parquet(f"{tmp_path}/out/acks")
    assert ack_rows(acks) == [("x", False), ("x", True), ("y", False)]
    (bad,) = spark.read.parquet(f"{tmp_path}/out/quarantine").collect()
    assert bad.value == "broken" and bad.reasons[0].description == "not a JSON frame" and bad.received_at


def test_quarantine_can_be_decoded_again(spark, frames, tmp_path):
    run(spark, frames, str(tmp_path), [[frame(agent="", key="q", cpu=7.0, rx=1.5, labels={"a": "b"})]])
    quarantine = spark.read.parquet(f"{tmp_path}/out/quarantine")
    again, _ = decode_frames(quarantine.select("value", "received_at"))
    (row,) = again.collect()
    assert (row.idempotency_key, row.system.cpu_utilization_pct, row.network.rx_mbps, row.labels) == ("q", 7.0, 1.5, {"a": "b"})


def test_another_checkpoint_is_refused(spark, frames, tmp_path):
    run(spark, frames, str(tmp_path), [[frame(key="a")]])
    stream = source(spark, frames, f"{tmp_path}/more", [[frame(key="b")]])
    with pytest.raises(Exception, match="belongs to another checkpoint"):
        ing.run_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/other").awaitTermination()


def test_odd_keys_numbers_and_clocks(spark, frames, tmp_path):
    null_key = [list(frame(when=float(i), received=float(i))) for i in range(3)]
    for row in null_key:
        row[3] = None
    year = 365 * 86_400.0
    parts = [
        [tuple(null_key[0]), frame(key="k", received=1, when=1, seq=900), frame(key="k", received=1, when=1, seq=900)],
        [tuple(null_key[1]), frame(key="far", received=year, when=2.0), frame(key="x", received=2, when=2.0), frame(key="y", received=2, when=2.0)],
        [tuple(null_key[2]), frame(key="k", received=3, when=3.0)],
    ]
    run(spark, frames, str(tmp_path), parts)
    acks = spark.read.parquet(f"{tmp_path}/out/acks").collect()
    got = sorted((r.idempotency_key or "", r.server_received_at is not None) for r in acks)
    assert got == [("", False), ("", False), ("", True), ("far", True), ("k", False), ("k", False), ("k", True), ("x", True), ("y", True)]
    assert {r.agent_id for r in ing.read_state(spark, f"{tmp_path}/out").collect()} == {"a1"}


def test_whole_copies_now_and_then(spark, frames, tmp_path, monkeypatch):
    monkeypatch.setattr(ing, "WHOLE_EVERY", 2)
    parts = [[frame(agent=f"a{i}", key=f"k{i}", when=float(i), received=float(i))] for i in range(6)]
    parts.append([frame(agent="a0", key="k0", when=7.0, received=7.0), frame(agent="a9", key="k9", when=7.0, received=7.0)])
    run(spark, frames, str(tmp_path), parts)
    acks = spark.read.parquet(f"{tmp_path}/out/acks").collect()
    assert sorted(r.idempotency_key for r in acks if r.server_received_at) == [f"k{i}" for i in range(6)] + ["k9"]
    assert {r.agent_id for r in ing.read_state(spark, f"{tmp_path}/out").collect()} == {f"a{i}" for i in range(6)} | {"a9"}
    assert not (tmp_path / "out" / "seen" / "batch_id=1").exists() and (tmp_path / "out" / "seen" / "batch_id=6").exists()


def test_late_rows_are_dropped_and_counted(spark, frames, tmp_path):
    parts = [
        [frame(when=0.0, cpu=91.0)], [frame(when=600.0, cpu=92.0)], [frame(when=660.0, cpu=93.0)],
        [frame(when=1.0, cpu=94.0), frame(when=900.0, cpu=95.0)],
    ]
    stream = source(spark, frames, str(tmp_path), parts)
    query = sw.run_windows(stream, f"{tmp_path}/w", f"{tmp_path}/c", delay="0 seconds")
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    got = {r.window_start: r.anomaly_count for r in sw.read_windows(spark, f"{tmp_path}/w").collect()}
    assert got[at(0)] == 1 and dropped >= 1 and at(900) not in got


def test_streaming_dedup_and_state_on_spark_state(spark, frames, tmp_path):
    parts = [
        [frame(key="k", when=0.0, cpu=1.0, seq=1), frame(key="m", when=1.0, cpu=2.0, seq=2)],
        [frame(key="k", when=60.0, cpu=3.0, seq=3), frame(key="n", when=61.0, cpu=4.0, seq=4)],
    ]
    stream = source(spark, frames, str(tmp_path), parts)
    deduped = dedup_stream(stream).writeStream.format("memory").queryName("deduped").trigger(availableNow=True)
    deduped.option("checkpointLocation", f"{tmp_path}/c1").start().awaitTermination()
    assert sorted(r.idempotency_key for r in spark.table("deduped").collect()) == ["k", "m", "n"]
    state = state_stream(detect(stream)).writeStream.format("memory").queryName("latest").outputMode("complete")
    state.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start().awaitTermination()
    assert [(r.agent_id, r.cpu) for r in spark.table("latest").collect()] == [("a1", 4.0)]


def test_messages_keep_the_frame(spark, frames, tmp_path):
    anomaly_messages(detect(frames(frame(key="k", cpu=99.0, labels={"region": "eu"})))).write.parquet(f"{tmp_path}/m/batch_id=0")
    stream = sw.stream_messages(spark, f"{tmp_path}/m")
    query = stream.writeStream.format("memory").queryName("messages").trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    (row,) = spark.table("messages").collect()
    assert row.idempotency_key == "k" and row.labels == {"region": "eu"} and row.system.cpu_utilization_pct == 99.0


def test_checkpoint_dir_is_read_from_the_session(spark):
    from metricloom.session import fresh_dir

    assert fresh_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
