from decimal import Decimal

import pytest
from conftest import frame, ms, at
from pyspark.sql import functions as F

from metricloom.functions import keys, metrics, text
from metricloom.operators.detect import detect

MAX64 = 2**64 - 1
CASES = [
    ("a", 90.0, 0, 0, False),
    ("b", 90.0000001, 0, 0, True),
    ("c", None, 0, 0, False),
    ("d", 10.0, 91, 100, True),
    ("e", 10.0, 90, 100, False),
    ("f", 10.0, 91, 0, False),
    ("g", float("nan"), 0, 0, False),
    ("h", float("nan"), 95, 100, True),
    ("i", 10.0, MAX64, MAX64, True),
]


def test_threshold_detector(frames):
    rows = [
        frame(key=k, cpu=cpu, used=Decimal(used), total=Decimal(total)) for k, cpu, used, total, _ in CASES
    ]
    rows = [r if r[4] is None else r[:4] + ((r[4][0], r[4][1], r[4][2], 0.0, 0.0),) + r[5:] for r in rows]
    found = detect(frames(*rows, uint64="decimal(20,0)")).collect()
    assert {r.idempotency_key: r.is_anomaly for r in found} == {c[0]: c[4] for c in CASES}
    assert {(r.is_anomaly, r.severity, r.severity_name) for r in found} == {
        (True, 3, "SEVERITY_CRITICAL"),
        (False, 1, "SEVERITY_INFO"),
    }


def test_unset_scalars_in_present_group_count_as_zero(frames):
    row = detect(frames(frame(system=(None, None, None, None, None)))).select("is_anomaly", metrics.cpu_or_zero().alias("c")).first()
    assert (row.is_anomaly, row.c) == (False, 0.0)


def test_detector_from_pandas_udf(frames):
    @F.pandas_udf("boolean")
    def odd(cpu):
        return cpu.fillna(0) % 2 == 1

    detector = metrics.any_of(metrics.threshold_detector(), lambda: odd(F.col("system.cpu_utilization_pct")))
    found = detect(frames(frame(key="x", cpu=3.0), frame(key="y", cpu=4.0), frame(key="z", cpu=96.0)), detector)
    assert {r.idempotency_key: r.is_anomaly for r in found.collect()} == {"x": True, "y": False, "z": True}


def test_row_key_round_trip(spark):
    df = spark.createDataFrame([("a", at(0.123456)), ("a#b", at(1)), ("a", None)], "agent string, ts timestamp")
    key = keys.row_key(F.col("agent"), F.col("ts"))
    rows = df.select(key.alias("k"), keys.row_key_ms(key).alias("ms")).collect()
    assert rows[0].k == f"a#{2**63 - 1 - ms(at(0.123))}"
    assert rows[0].ms == ms(at(0.123))
    assert rows[1].ms is None
    assert rows[2].k == f"a#{2**63 - 1}" and rows[2].ms == 0


@pytest.mark.parametrize("key", ["nohash", "a#", "a#x", "a# 5", "a#1.5", "a#99999999999999999999", None])
def test_unparsable_row_keys(spark, key):
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(keys.row_key_ms(F.col("k"))).first()[0] is None


def test_milliseconds_round_down_also_before_the_epoch(spark):
    df = spark.sql("SELECT timestamp_micros(-1) AS t UNION ALL SELECT timestamp_micros(1999)")
    assert sorted(r[0] for r in df.select(keys.unix_ms(F.col("t"))).collect()) == [-1, 1]
    before = df.select(keys.row_key(F.lit("a"), F.col("t")).alias("k")).collect()
    assert f"a#{-(2**63)}" in {r.k for r in before}


def test_labels_text(spark):
    df = spark.createDataFrame([({"b": "1", "a": "<x>&\"y\""},), ({},), (None,)], "l map<string,string>")
    got = [r[0] for r in df.select(text.labels_json(F.col("l"))).collect()]
    assert got == ['{"a":"\\u003cx\\u003e\\u0026\\"y\\"","b":"1"}', None, None]


def test_trace_ids(spark):
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    zero = "00-" + "0" * 32 + "-" + "b" * 16 + "-01"
    df = spark.createDataFrame([(good,), (zero,), ("junk",), ("",), (None,)], "t string")
    got = df.select(text.trace_id(F.col("t")), text.span_id(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a" * 32, "b" * 16), (None, "b" * 16), (None, None), (None, None), (None, None)]


def test_stable_id_shape(spark):
    ids = spark.range(2).select(text.stable_id(F.lit("k"), F.col("id").cast("string")).alias("i")).collect()
    assert ids[0].i != ids[1].i and all([len(p) for p in r.i.split("-")] == [8, 4, 4, 4, 12] for r in ids)


def test_severity_names(spark):
    df = spark.createDataFrame([(0,), (2,), (9,)], "c int")
    assert [r[0] for r in df.select(metrics.severity_name(F.col("c"))).collect()] == [
        "SEVERITY_UNSPECIFIED",
        "SEVERITY_WARNING",
        "SEVERITY_UNSPECIFIED",
    ]


def test_utc_text_whatever_the_session(spark):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from metricloom.functions.keys import rfc3339, rfc3339_micros, utc_date
    from metricloom.sources.frames_json import decode_frames

    micros = [0, 1_709_287_200_123_456, 1_711_846_800_000_000, 1_729_990_800_000_001, -1, -86_400_000_001]
    frame = spark.createDataFrame([(m,) for m in micros], "m bigint")
    at = F.timestamp_micros("m")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/St_Johns"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = frame.select("m", rfc3339(at).alias("s"), rfc3339_micros(at).alias("u"), utc_date(at).cast("string").alias("d")).collect()
            for r in rows:
                want = datetime.fromtimestamp(r.m // 10**6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
                assert (r.s, r.u, r.d) == (want + "Z", f"{want}.{r.m % 10**6:06}Z", want[:10])
            text = spark.createDataFrame([('{"agent_id":"a","collected_at":"2024-03-31T01:30:00Z"}',)], "value string")
            decoded = decode_frames(text)[0].select(F.unix_micros("collected_at").alias("m")).first()
            assert decoded.m == 1_711_848_600_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
