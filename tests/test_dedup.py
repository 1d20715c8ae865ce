import random

import pytest
from conftest import frame

from metricloom.operators.dedup import (
    accepted,
    dedup_batch,
    dedup_batch_ttl,
    mark_duplicates,
    mark_duplicates_ttl,
)


def simulate(rows, ttl=600, sweep=300):
    """A map of seen keys, swept at every multiple of ``sweep``, in arrival order: {seq: is_duplicate}.

    T0 is a multiple of the sweep interval, so seconds after T0 have the same slots.
    """
    seen, flags, done = {}, {}, None
    for when, seq, key in sorted(rows):
        slot = int(when // sweep)
        for tick in range((slot if done is None else done + 1), slot + 1):
            for old in [k for k, first in seen.items() if tick * sweep - first > ttl]:
                del seen[old]
        done = slot
        flags[seq] = key in seen
        seen.setdefault(key, when)
    return flags


def as_frames(frames, rows):
    return frames(*[frame(key=k, received=t, when=0.0, seq=s) for t, s, k in rows])


def flags(df):
    return {r.arrival_seq: r.is_duplicate for r in df.collect()}


def test_key_is_global_and_empty_key_is_a_key(frames):
    rows = frames(
        frame(agent="a1", key="k", seq=1), frame(agent="a2", fleet="f2", key="k", seq=2),
        frame(key="", seq=3), frame(key="", seq=4),
    )
    assert flags(mark_duplicates(rows)) == {1: False, 2: True, 3: False, 4: True}
    assert {r.arrival_seq for r in dedup_batch(rows).collect()} == {1, 3}


def test_forgetting_edges(frames):
    # first seen at 0 s: slots 0..2 remember it, the sweep at 900 s removes it; likewise from 299 s
    rows = [(0, 1, "k"), (599, 2, "k"), (601, 3, "k"), (899, 4, "k"), (900, 5, "k"), (1799, 6, "k"), (1800, 7, "k"),
            (299, 8, "m"), (899.5, 9, "m"), (900, 10, "m")]
    expected = simulate(rows)
    assert [s for s, dup in expected.items() if not dup] == [1, 8, 5, 10, 7]
    assert flags(mark_duplicates_ttl(as_frames(frames, rows))) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forgetting_against_simulation(frames, seed):
    """Random traffic in which one key has a third of all rows."""
    rng = random.Random(seed)
    rows = []
    times = sorted(rng.uniform(0, 4 * 3600) for _ in range(1500))
    for seq, when in enumerate(times):
        key = "" if rng.random() < 0.33 else f"k{rng.randrange(120)}"
        rows.append((round(when, 3), seq, key))
    df = as_frames(frames, rows).repartition(6)
    expected = simulate(rows)
    assert flags(mark_duplicates_ttl(df)) == expected
    assert {r.arrival_seq for r in dedup_batch_ttl(df).collect()} == {s for s, dup in expected.items() if not dup}


def test_other_limits(frames):
    rows = [(t, i, "k") for i, t in enumerate(range(0, 7200, 45))]
    df = as_frames(frames, rows)
    expected = simulate(rows, ttl=1200, sweep=600)
    assert flags(mark_duplicates_ttl(df, "20 minutes", "10 minutes")) == expected
    with pytest.raises(ValueError):
        mark_duplicates_ttl(df, "10 minutes", "7 minutes")


def test_remembered_keys_from_earlier_input(spark, frames):
    df = as_frames(frames, [(0, 1, "k"), (0, 2, "m"), (900, 3, "k")])
    base = 1709287200 // 300  # slot of T0
    seen = spark.createDataFrame([("k", base - 1), ("m", base - 3)], "idempotency_key string, bucket bigint")
    assert {r.arrival_seq for r in accepted(df, seen=seen).collect()} == {2, 3}


def test_a_busy_year_of_one_key_is_walked_in_one_go(spark):
    """Every sweep slot of a year: a key is accepted once in three slots."""
    n = 105_120
    rows = spark.range(n).selectExpr(
        "'' AS idempotency_key", "timestamp_micros(id * 300000000L) AS received_at", "id AS arrival_seq"
    )
    from metricloom.operators.dedup import accepted

    assert accepted(rows).count() == n // 3
