import random

import numpy as np
import pytest
from conftest import at, frame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from metricloom.operators import latency as la
from metricloom.operators.dedup import mark_duplicates
from metricloom.operators.detect import detect
from metricloom.operators.logs import log_summary, render_log
from metricloom.operators.alerts import responses
from metricloom.operators.windows import fleet_region_day, fleet_windows, format_windows
from metricloom.sources.store import write_windows
from metricloom.streaming.fleet_windows import read_windows

LOG = "method string, started_at timestamp, ended_at timestamp, duration_s double, code string"


def rpc(spark, rows):
    data = [(m, at(s), at(s + d), d, c) for m, s, d, c in rows]
    return spark.createDataFrame(data, LOG)


def test_window_edges_and_rows_without_system(frames):
    rows = frames(
        frame(when=59.999999, cpu=90.0), frame(when=60.0, cpu=80.0), frame(when=61.0), frame(fleet="", when=1.0, cpu=1.0)
    )
    got = {r.window_start: (r.anomaly_count, r.avg_cpu_during_anomalies) for r in fleet_windows(rows).collect()}
    assert got == {at(0): (1, 90.0), at(60): (2, 40.0)}
    text = format_windows(fleet_windows(rows)).orderBy("window_start").first()
    assert (text.window_start, text.window_end) == ("2024-03-01T10:00:00Z", "2024-03-01T10:01:00Z")


def test_window_table_appends_and_checks_types(spark, frames, tmp_path):
    windows = fleet_windows(frames(frame(when=0.0, cpu=91.0)))
    write_windows(windows, str(tmp_path / "w"))
    write_windows(windows, str(tmp_path / "w"))
    assert read_windows(spark, str(tmp_path / "w")).count() == 2
    with pytest.raises(AnalysisException):
        write_windows(format_windows(windows), str(tmp_path / "w"))


def test_redelivered_messages_count_twice_and_extra_aggregates(frames):
    rows = frames(frame(key="k", when=1.0, cpu=91.0), frame(key="k", when=1.0, cpu=91.0))
    (row,) = fleet_windows(rows, extra={"agents": F.count_distinct("agent_id")}).collect()
    assert (row.anomaly_count, row.agents) == (2, 1)


def test_region_day(frames):
    rows = frames(frame(cpu=91.0, labels={"region": "eu"}), frame(cpu=93.0, labels={"region": "eu"}), frame(cpu=95.0))
    got = {r.region: (r.anomaly_count, r.avg_cpu_during_anomalies) for r in fleet_region_day(rows).collect()}
    assert got == {"eu": (2, 92.0), None: (1, 95.0)}


def test_histogram_and_bucket_quantile(spark):
    log = rpc(spark, [("m", i, d, "OK") for i, d in enumerate([0.0005, 0.001, 0.003, 0.02, 7.0])])
    hist = la.latency_histogram(log, window="1 day")
    by_le = {r.le: r.cumulative for r in hist.collect()}
    assert by_le[0.001] == 2 and by_le[0.005] == 3 and by_le[5.0] == 4 and by_le[float("inf")] == 5
    assert hist.first()["count"] == 5
    # rank 2.5 of 5 lies half-way into (0.001, 0.005]; rank 4.95 lies beyond the last finite bound
    (half,) = la.quantile_from_buckets(hist, 0.5).collect()
    assert half.quantile == pytest.approx(0.001 + 0.004 * 0.5)
    assert la.quantile_from_buckets(hist, 0.99).first().quantile == 5.0
    assert la.quantile_from_buckets(hist, 0.2).first().quantile == pytest.approx(0.0005)


def test_bucket_quantile_adds_methods(spark):
    log = rpc(spark, [("a", 0, 0.0005, "OK"), ("b", 0, 0.004, "OK")])
    assert la.quantile_from_buckets(la.latency_histogram(log, window="1 day"), 0.75).count() == 1


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles_against_numpy(spark, n):
    """A third of all durations are equal; the others reach over many slots."""
    rng = random.Random(n)
    values = [0.002 if rng.random() < 0.33 else round(rng.expovariate(20), 6) for _ in range(n)]
    probabilities = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    log = rpc(spark, [("m", 0, v, "OK") for v in values] + [("other", 0, 1.5, "OK")])
    got = {r.probability: r.value for r in la.exact_quantiles(log.filter("method = 'm'"), probabilities).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-9)
    grouped = la.exact_quantiles(log, [0.5], by=("method",)).collect()
    assert {r.method: round(r.value, 9) for r in grouped}["other"] == 1.5 and len(grouped) == 2


def test_load_report(spark):
    log = rpc(spark, [("m", 0, 1.0, "OK"), ("m", 1, 2.0, "OK"), ("m", 3, 7.0, "INTERNAL")])
    got = {(r.section, r.metric): r.value for r in la.load_report(log).collect()}
    assert got["summary", "count"] == 3 and got["summary", "total"] == 10.0 and got["summary", "rps"] == 0.3
    assert got["latency", "p50.0"] == 2.0 and got["status", "OK"] == 2 and got["summary", "slowest"] == 7.0


def test_inflight(spark):
    log = rpc(spark, [("m", 0, 200.0, "OK"), ("m", 30, 10.0, "OK"), ("m", 70, 1.0, "OK")])
    got = {r.bucket_start: r.inflight for r in la.inflight(log).collect()}
    assert got == {at(0): 1, at(60): 1, at(180): 0}


def test_golden_signals_and_totals(spark, frames):
    log = rpc(spark, [("m", 0, 0.1, "OK"), ("m", 1, 0.1, "INTERNAL"), ("m", 2, 0.1, "OK"), ("n", 2, 0.1, "OK")])
    got = {(r.method, r.code): (r.handled, round(r.error_rate, 6)) for r in la.golden_signals(log).collect()}
    assert got == {("m", "OK"): (2, 0.333333), ("m", "INTERNAL"): (1, 0.333333), ("n", "OK"): (1, 0.0)}
    marked = detect(mark_duplicates(frames(frame(key="k", cpu=95.0), frame(key="k", cpu=95.0), frame(cpu=1.0))))
    assert [tuple(r) for r in la.message_totals(marked).collect()] == [("f1", 3, 4)]


def test_log_scan(spark, frames):
    lines = [
        "starting up: nothing to see",
        "2029/12/24 21:22:23 Received ack for key-17",
        "2029/12/24 21:22:23 Received ack for key-18",
        "2029/12/24 21:22:23 Received alert! SEVERITY_CRITICAL: Anomaly detected: metric threshold exceeded",
        '{"fleetId":"north-hall","activeAgentCount":42,"agents":[]}',
    ]
    got = log_summary(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {(r.kind, str(r.second), r.lines, r.active_agents) for r in got} == {
        ("other", "None", 1, None),
        ("ack", "2029-12-24 21:22:23", 2, None),
        ("alert", "2029-12-24 21:22:23", 1, None),
        ("status", "None", 1, 42),
    }
    marked = detect(mark_duplicates(frames(frame(key="k", cpu=95.0))))
    assert {r.value for r in render_log(responses(marked)).collect()} == {
        "2024/03/01 10:00:00 Received ack for k",
        "2024/03/01 10:00:00 Received alert! SEVERITY_CRITICAL: Anomaly detected: metric threshold exceeded",
    }
