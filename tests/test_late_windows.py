"""The window job that keeps late rows, against a simulation; windows, late rows and open windows hold every anomaly."""

import random

from conftest import T0, at, frame

from metricloom.operators.detect import detect
from metricloom.schemas import frame_schema
from metricloom.streaming import late_windows as lw


def simulate(batches, width=60, delay=600):
    """(windows, late, open) by fleet and window start, in seconds after T0."""
    clock, sums, late, over = None, {}, [], {}
    for rows in batches:
        begin = clock
        for fleet, when in rows:
            start = int(when // width) * width
            if begin is not None and start + width <= begin - delay:
                late.append((fleet, when))
            else:
                sums[fleet, start] = sums.get((fleet, start), 0) + 1
            clock = when if clock is None else max(clock, when)
        for key in [k for k in sums if clock is not None and k[1] + width <= clock - delay]:
            assert key not in over
            over[key] = sums.pop(key)
    return over, sorted(late), sums


def test_nothing_is_lost(spark, frames, tmp_path):
    rng, batches = random.Random(14), []
    for number in range(5):
        times = [round(number * 900 + rng.uniform(-1500, 900), 3) for _ in range(60)]
        batches.append([(rng.choice(["f1", "f1", "f2"]), max(0.0, when)) for when in times])
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        frames(*[frame(fleet=f, when=w, received=w, cpu=99.0) for f, w in rows]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame_schema("bigint")).option("maxFilesPerTrigger", 1).parquet(path)
    lw.run_late_windows(detect(stream).filter("is_anomaly"), out, str(tmp_path / "checkpoint")).awaitTermination()
    over, late, still = simulate(batches)
    seconds = lambda moment: (moment - T0).total_seconds()
    windows = spark.read.parquet(f"{out}/windows").collect()
    assert {(r.fleet_id, seconds(r.window_start)): r.anomaly_count for r in windows} == over and len(windows) == len(over)
    found = spark.read.parquet(f"{out}/late").collect()
    assert sorted((r.fleet_id, seconds(r.event_time)) for r in found) == late and len(late) > 10
    assert {(r.fleet_id, seconds(r.window_start)): r.anomaly_count for r in lw.read_open(spark, out).collect()} == still
    assert sum(over.values()) + len(late) + sum(still.values()) == 300
    assert sum(r.late_rows for r in lw.late_counts(spark, out).collect()) == len(late)


def test_a_batch_that_comes_again_changes_nothing(spark, frames, tmp_path):
    out = str(tmp_path / "out")
    first, second = detect(frames(frame(fleet="f", when=0.0, cpu=99.0))), detect(frames(frame(fleet="f", when=1000.0, cpu=95.0)))
    for number, batch in ((0, first), (1, second), (1, second)):
        lw.window_batch(batch, number, out, "1 minute", "10 minutes", "collected_at")
    empty = detect(frames(frame(fleet="", when=1.0, cpu=99.0)))  # without a fleet: in no window
    lw.window_batch(empty, 2, out, "1 minute", "10 minutes", "collected_at")
    rows = spark.read.parquet(f"{out}/windows").collect()
    assert [(r.window_start, r.anomaly_count, r.avg_cpu_during_anomalies) for r in rows] == [(at(0), 1, 99.0)]
    assert lw.read_open(spark, out).first().cpu_sum == 95.0 and spark.read.parquet(f"{out}/late").count() == 0
