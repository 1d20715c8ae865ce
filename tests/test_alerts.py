import random
from datetime import timedelta

import pytest
from conftest import T0, at, frame

from metricloom.operators import alerts as al
from metricloom.operators.asof import asof_last
from metricloom.operators.dedup import mark_duplicates
from metricloom.operators.detect import anomaly_messages, detect, policy_detect, trace_join
from metricloom.schemas import ALERTS, POLICIES

SUBS = "agent_id string, fleet_id string, subscribed_at timestamp, unsubscribed_at timestamp"


def alert_table(spark, rows):
    return spark.createDataFrame([(i, a, f, 3, "SEVERITY_CRITICAL", "m", t) for i, a, f, t in rows], ALERTS)


def test_one_ack_without_alert_for_a_quiet_frame(frames):
    marked = detect(mark_duplicates(frames(frame(key="k", cpu=50.0))))
    rows = al.responses(marked).collect()
    assert [(r.kind, r.ack.idempotency_key) for r in rows] == [("ack", "k")]
    assert rows[0].ack.server_received_at is not None


def test_alert_precedes_ack_and_duplicates_get_a_bare_ack(frames):
    marked = detect(mark_duplicates(frames(frame(key="k", cpu=95.0, seq=1), frame(key="k", cpu=95.0, seq=2))))
    rows = al.responses(marked).orderBy("arrival_seq", "ord").collect()
    assert [(r.arrival_seq, r.kind) for r in rows] == [(1, "alert"), (1, "ack"), (2, "ack")]
    assert rows[2].ack.server_received_at is None and rows[0].alert.severity == 3
    assert sorted(r.server_received_at is None for r in al.acks(marked).collect()) == [False, True]


def test_alert_ids_repeat_on_replay_and_differ_by_acceptance(frames):
    rows = [frame(key="k", cpu=95.0, received=0, seq=1), frame(key="k", cpu=95.0, received=1200, seq=2)]
    first, second = (sorted(r.alert_id for r in al.build_alerts(detect(frames(*rows))).collect()) for _ in range(2))
    assert first == second and len(set(first)) == 2


def test_routing_follows_the_registration_in_force(spark):
    subs = spark.createDataFrame(
        [("a", "f", at(100), None), ("a", "f", at(200), at(300)), ("b", "f", at(0), at(50))], SUBS
    )
    times = {"before": 99, "first": 100, "replaced": 200, "late": 299, "ended": 300}
    rows = [(n, "a", "f", at(s)) for n, s in times.items()] + [("b1", "b", "f", at(49)), ("b2", "b", "f", at(7200)),
                                                               ("c1", "c", "f", at(5))]
    alerts = alert_table(spark, rows)
    got = {r.alert_id: r.subscribed_at for r in al.route_alerts(alerts, subs).collect()}
    assert got == {"first": at(100), "replaced": at(200), "late": at(200), "b1": at(0)}
    assert {r.alert_id for r in al.undelivered(alerts, subs).collect()} == {"before", "ended", "b2", "c1"}


def test_end_of_a_replaced_stream_removes_the_newer_one(spark):
    subs = spark.createDataFrame([("a", "f", at(0), at(100)), ("a", "f", at(50), None)], SUBS)
    alerts = alert_table(spark, [("x", "a", "f", at(60)), ("y", "a", "f", at(150))])
    assert {r.alert_id: r.subscribed_at for r in al.route_alerts(alerts, subs).collect()} == {"x": at(50)}


@pytest.mark.parametrize("bucket", ["1 minute", "1 hour", "1 day"])
def test_asof_against_brute_force(spark, bucket):
    """One key has a third of all rows; times collide."""
    rng = random.Random(7)

    def key():
        return "hot" if rng.random() < 0.33 else f"k{rng.randrange(9)}"

    left = [(i, key(), T0 + timedelta(seconds=rng.randrange(0, 20000, 7))) for i in range(600)]
    right = [(i, key(), T0 + timedelta(seconds=rng.randrange(0, 20000, 7))) for i in range(150)]
    right = list({(k, t): (i, k, t) for i, k, t in right}.values())
    got = asof_last(
        spark.createDataFrame(left, "id int, k string, t timestamp"),
        spark.createDataFrame(right, "rid int, k string, rt timestamp"),
        on="k", left_time="t", right_time="rt", values=["rid"], tie_break="rid", bucket=bucket,
    )
    expected = {}
    for i, k, t in left:
        before = [(rt, rid) for rid, rk, rt in right if rk == k and rt <= t]
        expected[i] = max(before)[1] if before else None
    assert {r.id: r.rid for r in got.collect()} == expected


def test_burst_fills_the_buffer(spark):
    alerts = alert_table(spark, [(f"x{i:02}", "a", "f", at(i)) for i in range(12)] + [("y", "b", "f", at(0))])
    delivered, overflow = al.deliver(alerts)
    assert sorted(r.alert_id for r in delivered.collect()) == [f"x{i:02}" for i in range(10)] + ["y"]
    assert sorted(r.alert_id for r in overflow.collect()) == ["x10", "x11"]
    later = alert_table(spark, [(f"z{i:02}", "a", "f", at(60 + i)) for i in range(3)])  # the next minute's buffer is empty
    assert al.deliver(alerts.union(later))[0].filter("agent_id = 'a'").count() == 13
    assert al.alert_history(alerts, "f", 100).count() == 13


def test_feed_and_history(spark):
    alerts = alert_table(spark, [("x", "a", "f1", at(0)), ("y", "a", "f2", at(5)), ("z", "b", "f1", at(9))])
    assert {r.alert_id for r in al.agent_alerts(alerts, "a").collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        al.agent_alerts(alerts, "")
    assert [r.alert_id for r in al.alert_history(alerts, "f1", 1).collect()] == ["z"]


def test_policies(spark, frames):
    policies = spark.createDataFrame(
        [("p1", "f1", 10.0, 10.0, True), ("p2", "f1", 50.0, 50.0, True), ("p3", "f2", 1.0, 1.0, False)], POLICIES
    )
    rows = frames(
        frame(key="a", fleet="f1", cpu=40.0), frame(key="b", fleet="f1", cpu=51.0), frame(key="c", fleet="f2", cpu=89.0),
        frame(key="d", fleet="f3", cpu=91.0), frame(key="e", fleet="f1", cpu=1.0, used=51, total=100),
    )
    found = policy_detect(rows, policies).collect()
    assert {r.idempotency_key: r.is_anomaly for r in found} == dict(a=False, b=True, c=False, d=True, e=True)


def test_messages_and_trace_join(spark, frames):
    trace = "00-" + "c" * 32 + "-" + "d" * 16 + "-01"
    rows = frames(frame(key="k", cpu=99.0, traceparent=trace), frame(key="m", cpu=99.0), frame(key="n", cpu=1.0))
    messages = anomaly_messages(detect(rows))
    got = {r.payload.split('"idempotency_key":"')[1][0]: r.attributes for r in messages.collect()}
    assert set(got) == {"k", "m"}
    assert got["k"] == {"traceparent": trace, "tracestate": "", "agent_id": "a1", "fleet_id": "f1"}
    logs = spark.createDataFrame(
        [(trace, at(1), "OK"), (trace, at(3), "INTERNAL"), (None, at(2), "OK")],
        "traceparent string, logged_at timestamp, code string",
    )
    (row,) = trace_join(messages, logs).collect()
    assert (row.log_count, row.error_count, row.first_logged_at, row.last_logged_at) == (2, 1, at(1), at(3))
