"""Retention in place against ``apply_retention``, and redelivery against a simulation."""

import glob
from datetime import datetime, timedelta

import pytest
from conftest import T0, at, frame, ms

from metricloom.operators.store import apply_retention, store_rows
from metricloom.sources.alert_feed import decode_alerts
from metricloom.sources.retention import _stage, collect_garbage_in_place
from metricloom.sources.store import write_dated
from metricloom.streaming import redelivery

DAY = 86400.0
LIMITS = {"system_ttl_days": 3, "meta_ttl_days": 6, "versions": 2}


def stored(frames):
    """Ten days, a few versions per key, some without a group."""
    rows = []
    for day in range(10):
        for hour in (0, 5, 23):
            for version in range(3):
                cpu = None if version == 2 else 10.0 * day + version
                rows.append(frame(agent=f"a{hour}", when=day * DAY + hour * 3600 - 36000, cpu=cpu, rx=1.0 * version, key=f"k{day}-{hour}-{version}"))
    return store_rows(frames(*rows))


def rows_of(df):
    return sorted((r.row_key, r.idempotency_key, r.system and r.system[0], r.network and r.network[0]) for r in df.collect())


def files(path):
    return {f.split("event_date=")[1].split("/")[0]: f for f in glob.glob(f"{path}/event_date=*/*.parquet")}


def test_retention_in_place_equals_retention(spark, frames, tmp_path):
    path, rows = str(tmp_path / "store"), stored(frames)
    write_dated(rows, path)
    dates = len(files(path))
    for days, (dropped, rewritten) in {5: (0, None), 7: (None, None), 7.5: (None, None), 12: (None, None)}.items():
        as_of = T0 + timedelta(days=days)
        before = files(path)
        counts = collect_garbage_in_place(spark, path, as_of, **LIMITS)
        assert sum(counts.values()) == len(before)
        assert rows_of(spark.read.parquet(path)) == rows_of(apply_retention(rows, as_of, **LIMITS))
        after = files(path)
        assert sum(after.get(d) == f for d, f in before.items()) == counts["untouched"]
    assert len(files(path)) < dates


def test_only_changed_dates_are_rewritten(spark, frames, tmp_path):
    path, as_of = str(tmp_path / "store"), datetime(2024, 3, 8)
    write_dated(stored(frames), path)
    collect_garbage_in_place(spark, path, as_of, **LIMITS)
    # midnight: no limit runs through a date, so a second run has nothing to do
    assert collect_garbage_in_place(spark, path, as_of, **LIMITS)["rewritten"] == 0
    # a later write to one date
    write_dated(store_rows(frames(frame(agent="new", when=6 * DAY, cpu=1.0))), path)
    assert collect_garbage_in_place(spark, path, as_of, **LIMITS)["rewritten"] == 1
    # a day later one date passes the system limit and one the meta limit
    counts = collect_garbage_in_place(spark, path, as_of + timedelta(days=1), **LIMITS)
    assert counts["dropped"] == 1 and counts["rewritten"] == 1 and counts["untouched"] > 4
    # a run that ended before its manifest was written
    from metricloom.sources.retention import MANIFEST
    from metricloom.streaming.tables import delete_path

    before = rows_of(spark.read.parquet(path))
    delete_path(spark, f"{path}/{MANIFEST}")
    collect_garbage_in_place(spark, path, as_of + timedelta(days=1), **LIMITS)
    assert rows_of(spark.read.parquet(path)) == before
    # nothing left at all
    assert collect_garbage_in_place(spark, path, as_of + timedelta(days=99), **LIMITS)["untouched"] == 0 and files(path) == {}


def test_stages_of_a_date():
    day, now = datetime(2024, 3, 5).date(), ms(datetime(2024, 3, 8))
    assert [_stage(day, now + d * 86_400_000, 3, 6) for d in (-1, 0, 1, 3, 4)] == ["fresh", "fresh", "old", "old", "gone"]
    assert _stage(day, now + 1, 3, 6) == "crossed" and _stage(day, now + 3 * 86_400_000 + 1, 3, 6) == "crossed"


GOOD, BAD, MENDED = ['{"alertId":"%s","agentId":"a"}' % n for n in ("g", "x", "m")]


def fed(spark, tmp_path, batches, decode=decode_alerts, most=3):
    for rows in batches:
        spark.createDataFrame(rows, "value string, received_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    redelivery.run_redelivery(stream, out, str(tmp_path / "checkpoint"), most, "10 seconds", decode).awaitTermination()
    alerts = sorted((r.alert_id, r.batch_id) for r in spark.read.parquet(f"{out}/alerts").collect())
    return alerts, sorted((r.value, r.attempt, r.batch_id) for r in spark.read.parquet(f"{out}/parked").collect())


def test_failures_wait_longer_and_are_parked(spark, tmp_path):
    """Fails at 0, 10 and 30 seconds; a batch before the time leaves it alone."""
    batches = [[(GOOD, at(0)), ("{bad", at(0))], [(None, at(9))], [(None, at(10))], [(None, at(29))], [(None, at(30))], [(None, at(99))]]
    assert fed(spark, tmp_path, batches) == ([("g", 0)], [("{bad", 3, 4)])


def test_a_repaired_payload_is_delivered_once_also_after_a_restart(spark, tmp_path):
    def repair(tried):
        from pyspark.sql import functions as F

        fixed = F.when((F.col("attempt") == 1) & (F.col("value") == MENDED[:-1]), MENDED).otherwise(F.col("value"))
        return decode_alerts(tried.withColumn("value", fixed))

    first = [[(MENDED[:-1], at(0)), (BAD, at(0))], [(None, at(5))]]
    assert fed(spark, tmp_path, first, repair) == ([("x", 0)], [])
    assert fed(spark, tmp_path, [[(None, at(20))], [(GOOD, at(40))]], repair) == ([("g", 3), ("m", 2), ("x", 0)], [])
    # the second batch again: all it writes is there, so nothing changes
    out, batch = str(tmp_path / "out"), spark.createDataFrame([(None, at(20))], "value string, received_at timestamp")
    redelivery.deliver_batch(batch, 3, out, 3, "10 seconds", repair)
    assert sorted(r.alert_id for r in spark.read.parquet(f"{out}/alerts").collect()) == ["g", "m", "x"]
    with pytest.raises(ValueError):
        redelivery.run_redelivery(batch, out, out, most=0)
