"""User-defined combiners, mergeable quantile sketches and the incremental rollup."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
from conftest import at, frame
from pyspark.sql import functions as F

from metricloom.operators import sketches
from metricloom.operators.combine import Combiner, TopLabel, _groups, combine, combine_windows
from metricloom.operators.detect import detect
from metricloom.operators.windows import fleet_region_day, fleet_windows
from metricloom.streaming import rollup


def count_mean():
    """The aggregate that the window job has built in; made here, so that it travels by value."""

    class CountMean(Combiner):
        """The aggregate that the window job has built in."""

        output = "anomaly_count bigint, avg_cpu double"

        def create(self):
            return (0, 0.0)

        def add(self, accumulator, rows):
            return accumulator[0] + rows.num_rows, accumulator[1] + float(np.sum(rows.column("cpu").to_numpy()))

        def merge(self, one, other):
            return one[0] + other[0], one[1] + other[1]

        def extract(self, accumulator):
            return accumulator[0], accumulator[1] / accumulator[0]

    return CountMean()


def some_frames(frames, n=300):
    rng = random.Random(2)
    rows = []
    for _ in range(n):
        fleet = "" if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"f{rng.randrange(4)}"
        when = None if rng.random() < 0.05 else rng.uniform(0, 600)
        labels = {"kind": rng.choice("abc")} if rng.random() < 0.8 else {}
        rows.append(frame(fleet=fleet, when=when, received=700.0, cpu=float(rng.randrange(100)), labels=labels))
    return frames(*rows).repartition(5)


def test_a_combiner_equals_the_built_in_windows(frames):
    rows = some_frames(frames)
    mine = {(r.fleet_id, r.window_start): (r.anomaly_count, round(r.avg_cpu, 9)) for r in combine_windows(rows, count_mean(), ["cpu"]).collect()}
    built = fleet_windows(rows).collect()
    assert mine == {(r.fleet_id, r.window_start): (r.anomaly_count, round(r.avg_cpu_during_anomalies, 9)) for r in built}


def test_top_label_and_null_keys(spark):
    rng, rows = random.Random(3), []
    for _ in range(500):
        rows.append((rng.choice(["x", "y", None]), rng.choice([1, None]), rng.choice(["a", "b", None]), rng.choice([1.5, 0.0, None])))
    table = spark.createDataFrame(rows, "k string, m int, kind string, cpu double").repartition(7)
    expected = {}
    for k, m, kind, cpu in rows:
        sums = expected.setdefault((k, m), {})
        sums[kind] = sums.get(kind, 0) + (cpu or 0)
    found = {(r.k, r.m): r for r in combine(table, ["k", "m"], ["kind", "cpu"], TopLabel("kind"), held=3).collect()}
    assert found.keys() == expected.keys()
    for key, sums in expected.items():
        top = min(sums, key=lambda label: (-sums[label], label is not None, label or ""))
        assert (found[key].top_label, found[key].labels) == (top, len(sums))
        assert abs(found[key].cpu_share - sums[top] / sum(sums.values())) < 1e-9
    whole = combine(table, [], ["cpu", "kind"], TopLabel("kind")).collect()
    assert len(whole) == 1 and whole[0].labels == 3
    assert combine(table.filter("false"), ["k"], ["cpu", "kind"], TopLabel("kind")).count() == 0


def test_a_task_sends_one_accumulator_per_key(spark):
    """Of 40,000 rows in four tasks, at most four accumulators per key cross the exchange."""
    rows = spark.range(40_000, numPartitions=4).selectExpr("id % 3 AS k", "'a' AS kind", "1.0D AS cpu")
    df = combine(rows, ["k"], ["kind", "cpu"], TopLabel("kind"))
    assert df.count() == 3
    text = df._jdf.queryExecution().toString()
    assert text.count("MapInArrow") >= 2 and "FlatMapGroups" not in text
    batch = pa.RecordBatch.from_arrays([pa.array([2, None, 2, 1]), pa.array([1, 2, 3, 4])], ["k", "v"])
    assert {key: part.column(1).to_pylist() for key, part in _groups(batch, 1)} == {(2,): [1, 3], (None,): [2], (1,): [4]}


def requests(spark, n=20_000):
    rng = np.random.default_rng(4)
    seconds, values = rng.uniform(0, 7200, n), rng.lognormal(0, 1.5, n)
    rows = [("m1" if i % 3 else "m2", at(float(s)), float(v) if i % 50 else None) for i, (s, v) in enumerate(zip(seconds, values))]
    return spark.createDataFrame(rows, "method string, ended_at timestamp, duration_s double")


def test_sketches_keep_the_rank_error_however_they_merge(spark, tmp_path):
    log = requests(spark)
    sketches.write_sketches(sketches.sketch_log(log.filter("ended_at < timestamp'2024-03-01 11:00:00'")), str(tmp_path / "s"))
    sketches.write_sketches(sketches.sketch_log(log.filter("ended_at >= timestamp'2024-03-01 11:00:00'")), str(tmp_path / "s"))
    stored = sketches.read_sketches(spark, str(tmp_path / "s"))
    wanted = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    days = [
        sketches.merge_sketches(stored, "1 day"),
        sketches.merge_sketches(sketches.merge_sketches(stored, "10 minutes"), "1 day"),
        sketches.sketch_log(log, window="1 day"),
    ]
    for day in days:
        checked = sketches.rank_errors(sketches.sketch_quantiles(day, wanted), log, "1 day").collect()
        assert len(checked) == 2 * len(wanted) and all(r.rank_error <= sketches.RANK_ERROR for r in checked)
        assert sum(r.n for r in checked) == len(wanted) * log.filter("duration_s is not null").count()
    assert max(len(r.sketch) for r in days[0].collect()) < 40_000  # bounded, whatever it has seen
    hours = sketches.sketch_quantiles(sketches.merge_sketches(stored, None), [0.5])
    assert hours.columns == ["method", "n", "probability", "value"] and hours.count() == 2


def test_small_spans_are_exact_and_dates_are_pruned(spark, tmp_path):
    log = requests(spark, 600)
    found = sketches.rank_errors(sketches.sketch_quantiles(sketches.sketch_log(log, window="1 day"), [0.25, 0.5]), log, "1 day")
    assert all(r.rank_error == 0 for r in found.collect())
    sketches.write_sketches(sketches.sketch_log(log), str(tmp_path / "s"))
    assert sketches.read_sketches(spark, str(tmp_path / "s"), "2024-03-02").count() == 0
    assert sketches.read_sketches(spark, str(tmp_path / "s"), "2024-03-01", "2024-03-01").count() > 0


def rows_of(df):
    return sorted((str(r.window_date), r.region or "", r.fleet_id, r.anomaly_count, round(r.avg_cpu_during_anomalies, 9)) for r in df.collect())


def test_rollup_equals_recompute_and_survives_reruns(spark, frames, tmp_path):
    rng, batches = random.Random(6), []
    for _ in range(4):
        batches.append(frames(*[
            frame(fleet=rng.choice(["f1", "f2", ""]), when=float(rng.randrange(0, 3 * 86400)), cpu=rng.uniform(0, 100),
                  labels={"region": rng.choice(["eu", "us", "a/b=c"])} if rng.random() < 0.8 else {})
            for _ in range(60)
        ]))
    path, every = str(tmp_path / "rollup"), None
    for number, batch in enumerate(batches):
        rollup.merge_batch(batch, number, path)
        rollup.merge_batch(batch, number, path)  # once more
        every = batch if every is None else every.unionByName(batch)
        assert rows_of(rollup.read_rollup(spark, path)) == rows_of(fleet_region_day(every))
    for old in (0, 3):
        rollup.merge_batch(batches[old], old, path)  # late reruns
    assert rows_of(rollup.read_rollup(spark, path)) == rows_of(fleet_region_day(every))


def test_a_batch_rewrites_only_its_partitions(spark, frames, tmp_path):
    path = str(tmp_path / "rollup")
    build = lambda when, region: frames(frame(fleet="f", when=when, cpu=1.0, labels={"region": region}))
    rollup.merge_batch(build(0, "eu").unionByName(build(90000, "eu")), 0, path)
    files = lambda date: set(glob.glob(f"{path}/window_date={date}/region=eu/*.parquet"))
    before = files("2024-03-01"), files("2024-03-02")
    rollup.merge_batch(build(90000, "eu"), 1, path)
    assert files("2024-03-01") == before[0] and files("2024-03-02").isdisjoint(before[1])
    assert {r.anomaly_count for r in rollup.read_rollup(spark, path).filter("window_date = '2024-03-02'").collect()} == {2}
    # a crash after one of two partitions was written: only the other one is added again
    both = build(0, "eu").unionByName(build(90000, "eu"))
    rollup.merge_batch(build(0, "eu"), 2, path)
    rollup.merge_batch(both, 2, path)
    assert rows_of(rollup.read_rollup(spark, path).select("*"))[0][3] == 2
    assert rollup.read_rollup(spark, path).agg(F.sum("anomaly_count")).first()[0] == 5


def test_detected_stream_keeps_the_rollup_up(spark, frames, tmp_path):
    for part in range(3):
        frames(frame(fleet="f", when=60.0 * part, cpu=95.0, labels={"region": "eu"})).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = detect(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).filter("is_anomaly")
    rollup.run_rollup(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    assert rows_of(rollup.read_rollup(spark, str(tmp_path / "table"))) == [("2024-03-01", "eu", "f", 3, 95.0)]
    assert os.path.isdir(str(tmp_path / "table"))
