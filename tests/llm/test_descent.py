"""The descent of the shard tree against plain hashing, its movement, its cost, and clashing columns."""

import math
import os
import struct
import time
import zlib
from collections import Counter

import pytest
import xxhash

from metricloom.llm import shard_tree as st
from metricloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def chained(*values):
    """Spark's xxhash64 of longs, ints, strings and nulls: each value is hashed with the hash before it as seed."""
    seed = 42
    for kind, value in values:
        if value is not None:
            raw = value.encode() if kind == "string" else struct.pack("<q" if kind == "long" else "<i", value)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def slow_descent(doc_id, tree):
    """(region, rack, shard) for a bigint key."""

    def race(children, *path):
        draws = []
        for name, weight in children:
            kind = "int" if isinstance(name, int) else "string"
            u = ((chained(("long", doc_id), *[("string", p) for p in path], (kind, name)) >> 11) + 1) * 2.0**-53
            draws.append((-math.log(u) / weight, name))
        return min(draws)[1]

    weights = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    region = race([(r, sum(w.values())) for r, w in weights.items() if sum(w.values()) > 0])
    rack = race([(k, w) for k, w in weights[region].items() if w > 0], region)
    return region, rack, race([(s, w) for s, w in tree[region][rack].items() if w > 0], region, rack)


def placed(spark, n, tree):
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    return {r.doc_id: (r.region, r.rack, r.shard) for r in st.descend(rows, ["doc_id"], tree).collect()}


TREE = {"a": {"a1": {0: 1.0, 1: 3.0}, "a2": {2: 2.0}}, "b": {"b1": {3: 1.0, 4: 0.0}, "b2": {5: 1.0}, "b3": {6: 0.0}}, "c": {"c1": {7: 0.0}}}


@pytest.mark.parametrize("tree", [TREE, st.even_tree(8), st.even_tree(1), st.grow(st.even_tree(8), 8)], ids=["uneven", "eight", "one", "nine"])
def test_descent_equals_plain_hashing(spark, tree):
    for doc_id, where in placed(spark, 500, tree).items():
        assert where == slow_descent(doc_id, tree)


def test_every_level_follows_its_weights(spark):
    found = placed(spark, 40_000, TREE).values()
    for level, shares in enumerate([{"a": 6, "b": 2}, {"a1": 4, "a2": 2, "b1": 1, "b2": 1}, {0: 1, 1: 3, 2: 2, 3: 1, 5: 1}]):
        counts = Counter(where[level] for where in found)
        assert counts.keys() == shares.keys()
        for name, share in shares.items():
            assert abs(counts[name] - 5000 * share) < 5 * math.sqrt(5000 * share)


def test_movement_is_confined_to_changed_subtrees(spark):
    before = {f"r{r}": {f"k{k}": {100 * r + 10 * k + s: 1.0 for s in range(3)} for k in range(3)} for r in range(3)}
    after = {r: {k: dict(shards) for k, shards in racks.items()} for r, racks in before.items()}
    after["r1"]["k1"][111] = 4.0
    old, new = placed(spark, 30_000, before), placed(spark, 30_000, after)
    moved = [(old[i], new[i]) for i in old if old[i] != new[i]]
    assert moved and all(b[0] == "r1" for _, b in moved)  # nothing moves into or between the other regions
    assert all(b[1] == "k1" for a, b in moved if a[0] == "r1")  # nor between the other racks of the region
    assert all(b[2] == 111 for a, b in moved if a[:2] == ("r1", "k1"))  # nor between the other shards of the rack
    assert len(moved) < 30_000 * (12 / 30 - 9 / 27) * 3


@pytest.mark.parametrize("shards", [1, 2, 3, 7, 8, 16])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    tree = st.even_tree(shards)
    old, new = placed(spark, 8000, tree), placed(spark, 8000, st.grow(tree, shards))
    moved = [new[i][2] for i in old if old[i] != new[i]]
    assert set(moved) == {shards} and abs(len(moved) - 8000 / (shards + 1)) < 6 * math.sqrt(8000 / (shards + 1))


def test_thousands_of_shards(spark):
    """A key costs the children on its way: 20,000 shards in 27 regions of 27 racks or so."""
    for shards, fan in ((2000, 13), (20_000, 27)):
        tree = st.even_tree(shards, fan, fan)
        begin = time.time()
        found = placed(spark, 20_000, tree)
        assert time.time() - begin < 60
        assert len({where[2] for where in found.values()}) > min(shards, 20_000) * 0.6
        for doc_id in range(0, 20_000, 997):
            assert found[doc_id] == slow_descent(doc_id, tree)


def test_clashing_columns_and_null_keys(spark):
    columns = "doc_id long, _picked int, _part int, __amount int, _region string, shard string, slot string"
    rows = [(i % 7 or None, i, -i, 2 * i, f"r{i}", "x", "y") for i in range(100)]
    frame = spark.createDataFrame(rows, columns)
    found = st.add_slots(st.assign_shards(frame, ["doc_id"], st.even_tree(8)), ["doc_id", "_picked"]).collect()
    assert {(r.doc_id, r._picked, r._part, r["__amount"], r._region) for r in found} == {r[:5] for r in rows}
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    for shard in {r.shard for r in found}:
        slots = [r.slot for r in sorted((r for r in found if r.shard == shard), key=lambda r: (r.doc_id or 0, r._picked))]
        assert slots == list(range(len(slots)))
    with pytest.raises(ValueError):
        st.descend(frame, ["doc_id"], {"a": {"b": {0: 0.0}}})


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_query_equals_plain_hashing(spark):
    tree, slots = st.even_tree(8), {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op6_shard_tree"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in sorted(rows, key=lambda r: r.doc_id):
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.region, r.rack, r.shard) == slow_descent(r.doc_id, tree)
        assert r.grown_shard == slow_descent(r.doc_id, st.grow(tree, 8))[2] and r.grown_shard in (r.shard, 8)
        assert r.slot == slots.setdefault(r.shard, 0)
        slots[r.shard] += 1
