import json
from datetime import timedelta

from conftest import at, frame, ms

from metricloom.operators import status as st
from metricloom.operators.detect import detect
from metricloom.operators.state import active, advance_state, latest_state
from metricloom.operators.store import apply_retention, scan_agent, store_rows, upsert_frames
from metricloom.schemas import AGENT_STATE, REQUESTS
from metricloom.sources.store import collect_garbage, compact_store, read_store, write_frames


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), REQUESTS)


def test_same_millisecond_merges_groups(frames):
    store = upsert_frames(
        frames(
            frame(when=1.0001, key="one", cpu=5.0, labels={"a": "1"}, seq=1),
            frame(when=1.0009, key="two", rx=7.0, fleet="f2", seq=2),
            frame(when=1.001, key="three", cpu=9.0, seq=3),
        )
    )
    rows = {r.idempotency_key: r for r in store.collect()}
    assert set(rows) == {"two", "three"}
    assert rows["two"].system.cpu_utilization_pct == 5.0 and rows["two"].network.rx_mbps == 7.0
    assert rows["two"].labels == {"a": "1"} and rows["two"].fleet_id == "f2"
    assert rows["three"].labels is None and rows["three"].network is None


def test_frames_without_time_share_the_epoch_key(frames):
    (row,) = upsert_frames(frames(frame(when=None, cpu=1.0), frame(when=None, cpu=2.0))).collect()
    assert row.unix_ms == 0 and row.row_key == f"a1#{2**63 - 1}" and row.system.cpu_utilization_pct == 2.0


def test_scan_is_newest_first_and_ignores_the_fleet(frames):
    rows = [frame(when=float(i), key=f"k{i}", fleet=f"f{i % 2}", cpu=1.0) for i in range(5)]
    store = upsert_frames(frames(*rows, frame(agent="a12", when=50.0, cpu=1.0)))
    assert [r.idempotency_key for r in scan_agent(store, "a1", 3).collect()] == ["k4", "k3", "k2"]


def test_retention(frames):
    now = at(0) + timedelta(days=100)
    day = 86400.0
    rows = store_rows(
        frames(
            frame(when=9 * day, key="gone", cpu=1.0),
            frame(when=10 * day, key="meta-only", cpu=1.0, rx=1.0),
            frame(when=70 * day, key="edge", cpu=2.0),
            *[frame(agent="v", when=90 * day, key=f"v{i}", cpu=None if i == 4 else float(i)) for i in range(5)],
        )
    )
    kept = {(r.idempotency_key, r.version): r for r in apply_retention(rows, now).collect()}
    assert set(kept) == {("meta-only", 1), ("edge", 1), ("v4", 1), ("v3", 2), ("v2", 3)}
    assert kept["meta-only", 1].system is None and kept["meta-only", 1].network is None
    assert kept["edge", 1].system.cpu_utilization_pct == 2.0
    assert kept["v4", 1].system.cpu_utilization_pct == 3.0 and kept["v3", 2].system is None


def test_store_files_merge_over_writes(spark, frames, tmp_path):
    path = str(tmp_path / "store")
    write_frames(frames(frame(when=0.0, key="one", cpu=5.0, seq=1), frame(when=86400.0, key="next", cpu=1.0, seq=2)), path)
    write_frames(frames(frame(when=0.0, key="two", rx=7.0, seq=3)), path)
    rows = {r.idempotency_key: r for r in read_store(spark, path).collect()}
    assert set(rows) == {"two", "next"} and rows["two"].system.cpu_utilization_pct == 5.0
    assert {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()} == {
        "event_date=2024-03-01",
        "event_date=2024-03-02",
    }
    compact_store(spark, path, str(tmp_path / "compact"))
    compacted = spark.read.parquet(str(tmp_path / "compact"))
    assert {r.idempotency_key: r.network is None for r in compacted.collect()} == {"two": False, "next": True}
    collect_garbage(spark, path, str(tmp_path / "kept"), at(86400 * 90.5), versions=1)
    assert [r.idempotency_key for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == ["next"]


def test_recent_summary(frames):
    rows = [frame(when=float(i), cpu=float(i)) for i in range(20)]
    rows += [frame(agent="none", when=float(i)) for i in range(3)]
    rows += [frame(agent="mixed", when=float(i), cpu=None if i % 3 == 0 else float(i)) for i in range(10)]
    rows += [frame(agent="a#b", when=1.0, cpu=50.0)]
    got = {r.agent_id: (r.avg_cpu, r.last_seen_ms) for r in st.agent_recent_summary(upsert_frames(frames(*rows))).collect()}
    assert got["a1"] == (14.5, ms(at(19)))
    assert got["none"] == (0.0, ms(at(2)))
    assert got["mixed"] == (sum(i for i in range(10) if i % 3) / 6, ms(at(9)))
    assert got["a#b"] == (50.0, 0)


def test_recent_n_above_the_group_limit(frames):
    rows = [frame(when=float(i), cpu=1.0) for i in range(1300)] + [frame(agent="b", when=1.0, cpu=1.0)]
    got = st.recent_n(upsert_frames(frames(*rows)), 1200).collect()
    times = sorted(r.unix_ms for r in got if r.agent_id == "a1")
    assert times == [ms(at(i)) for i in range(100, 1300)]
    assert sorted(r.rn for r in got if r.agent_id == "a1") == list(range(1, 1201))


def test_state_is_the_last_arrival(frames):
    rows = detect(frames(frame(when=300.0, cpu=95.0, seq=1), frame(when=0.0, cpu=10.0, seq=2), frame(fleet="f2", seq=3)))
    got = {r.fleet_id: tuple(r)[2:] for r in latest_state(rows).collect()}
    assert got == {"f1": (10.0, ms(at(0)), 1), "f2": (0.0, ms(at(0)), 1)}


def test_state_advances_and_expires(spark, frames):
    now = at(0)
    seen = {"kept": -3600.0, "gone": -3600.001, "future": 500.0}
    state = latest_state(detect(frames(*[frame(agent=a, when=s) for a, s in seen.items()])))
    assert {r.agent_id for r in active(state, now).collect()} == {"kept", "future"}
    newer = detect(frames(frame(agent="gone", when=1.0, cpu=3.0, seq=0), frame(agent="new", when=1.0, seq=1)))
    after = {r.agent_id: r.cpu for r in advance_state(state, newer).collect()}
    assert after == {"kept": 0.0, "gone": 3.0, "future": 0.0, "new": 0.0}


def status_fixture(spark, frames):
    rows = [frame(when=float(i), cpu=float(i)) for i in range(12)]
    rows += [frame(agent="late", when=300.0, cpu=95.0), frame(agent="late", when=0.0, cpu=10.0)]
    rows += [frame(agent="both", fleet="f1", when=1.0, cpu=20.0), frame(agent="both", fleet="f2", when=2.0, cpu=40.0)]
    rows += [frame(agent="a#b", when=5.0, cpu=70.0), frame(agent="clockless", when=None, cpu=33.0)]
    df = frames(*rows)
    return latest_state(detect(df)), upsert_frames(df)


def test_fleet_status(spark, frames):
    state, store = status_fixture(spark, frames)
    asked = requests(spark, ("f1", 0), ("f2", 1), ("nobody", 5), ("f1", 2))
    agents = st.fleet_status_agents(state, store, asked)
    got = {(r.fleet_id, r.last_n_rows, r.agent_id): (r.avg_cpu_utilization_pct, r.last_seen_unix_ms) for r in agents.collect()}
    assert got["f1", 10, "a1"] == (6.5, ms(at(11))) and got["f1", 2, "a1"] == (10.5, ms(at(11)))
    assert got["f1", 10, "late"] == (52.5, ms(at(300)))
    assert got["f1", 10, "both"] == (30.0, ms(at(2))) and got["f2", 1, "both"] == (40.0, ms(at(2)))
    assert got["f1", 10, "a#b"] == (70.0, ms(at(5)))
    assert got["f1", 10, "clockless"] == (33.0, 0)
    assert len(got) == 5 + 5 + 1
    summary = {(r.fleet_id, r.last_n_rows): r.active_agent_count for r in st.fleet_status_summary(state, asked).collect()}
    assert summary == {("f1", 10): 5, ("f2", 1): 1, ("nobody", 5): 0, ("f1", 2): 5}


def test_placeholder(spark, frames):
    state, store = status_fixture(spark, frames)
    rows = st.fleet_status_agents(state, store, requests(spark, ("nobody", 5)), placeholder_as_of=at(7)).collect()
    assert [tuple(r) for r in rows] == [("nobody", 5, "no-active-agents", 0.0, ms(at(7)), 1)]


def test_status_documents(spark, frames):
    state, store = status_fixture(spark, frames)
    asked = requests(spark, ("f1", 10), ("nobody", 5))
    agents = st.fleet_status_agents(state, store, asked)
    nested = st.fleet_status(agents, asked, at(7))
    docs = {r.fleet_id: json.loads(r.document) for r in st.fleet_status_json(nested).collect()}
    assert docs["nobody"] == {"fleetId": "nobody", "activeAgentCount": 0, "agents": [], "asOf": "2024-03-01T10:00:07.000000Z"}
    assert [a["agentId"] for a in docs["f1"]["agents"]] == ["a#b", "a1", "both", "clockless", "late"]
    assert docs["f1"]["agents"][1] == {
        "agentId": "a1", "avgCpuUtilizationPct": 6.5, "lastSeenUnixMs": str(ms(at(11))), "status": "SEVERITY_INFO",
    }


def test_a_response_holds_its_whole_fleet(spark):
    n = 500
    state = spark.createDataFrame([("f", f"a{i}", 1.0, 5, 1) for i in range(n)], AGENT_STATE)
    store = upsert_frames(spark.createDataFrame([], "agent_id string, fleet_id string, collected_at timestamp, "
        "idempotency_key string, system struct<cpu_utilization_pct: double>, network struct<rx_mbps: double>, "
        "labels map<string,string>, arrival_seq bigint"))  # fmt: skip
    asked = requests(spark, ("f", 3))
    agents = st.fleet_status_agents(state, store, asked)
    (document,) = st.fleet_status(agents, asked, at(0)).collect()
    assert document.active_agent_count == n
    assert [a.agent_id for a in document.agents] == sorted(f"a{i}" for i in range(n))


def test_stand_in_is_counted(spark, frames):
    state, store = status_fixture(spark, frames)
    asked = requests(spark, ("nobody", 5))
    agents = st.fleet_status_agents(state, store, asked, placeholder_as_of=at(7))
    (row,) = st.fleet_status_json(st.fleet_status(agents, asked, at(7))).collect()
    document = json.loads(row.document)
    assert document["activeAgentCount"] == 1 and document["agents"][0]["agentId"] == "no-active-agents"


def test_every_request_gets_its_own_count(spark, frames):
    store = upsert_frames(frames(*[frame(when=float(i), cpu=float(i)) for i in range(50)]))
    state = spark.createDataFrame([("f1", "a1", 0.0, 1, 1)], AGENT_STATE)
    asked = requests(spark, ("f1", 3), ("f1", 30), ("f1", 5000))
    got = {r.last_n_rows: r.avg_cpu_utilization_pct for r in st.fleet_status_agents(state, store, asked).collect()}
    assert got == {3: 48.0, 30: 34.5, 5000: 24.5}


def test_garbage_collection_keeps_the_later_batch(spark, frames, tmp_path):
    from metricloom.sources.store import batch_rows, collect_garbage, read_store
    from metricloom.streaming.tables import write_batch

    for batch, (cpu, seq) in enumerate([(11.0, 9), (22.0, 1)]):  # numbers begin anew in every batch
        write_batch(batch_rows(frames(frame(key=f"k{batch}", cpu=cpu, seq=seq))), f"{tmp_path}/s", batch, ("event_date",))
    collect_garbage(spark, f"{tmp_path}/s", f"{tmp_path}/kept", at(60))
    for path in ("s", "kept"):
        assert [r.system.cpu_utilization_pct for r in read_store(spark, f"{tmp_path}/{path}").collect()] == [22.0]
