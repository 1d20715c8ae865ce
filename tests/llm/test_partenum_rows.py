"""What the Jaccard join makes rows of: not every bucket in which two sets meet, nor pairs their sketches rule out."""

import numpy as np

from metricloom.llm import partenum as p


def nearly(shared, own, seed=3):
    """Two sets of hashes with so many in common, and so many of their own each."""
    values = np.unique(np.random.default_rng(seed).integers(0, 2**63, shared + 2 * own, dtype=np.uint64))
    return [np.sort(np.concatenate((values[:shared], values[shared + i * own : shared + (i + 1) * own]))) for i in (0, 1)]


def crossing_rows(spark, sets, sigs=10):
    shared = spark.createDataFrame([(s, n, 0) for s in range(sigs) for n in range(len(sets))], "sig bigint, node bigint, first bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    stats = spark.createDataFrame([(n, p.sketch(s)) for n, s in enumerate(sets)], "node bigint, stats binary")
    opened = p.open_buckets(shared, roots, stats)
    return opened, p.crossing(opened, 80)


def test_buckets_of_the_same_nodes_are_opened_once(spark):
    a, b = nearly(400, 10)
    assert p.linked(a, b, 80)
    opened, found = crossing_rows(spark, [a, b])
    assert opened.count() == 2
    assert [tuple(r) for r in found.collect()] == [(0, 1)]


def test_finer_parities_discard_pairs_before_they_are_rows(spark):
    a, b = nearly(350, 50)
    one, two = (p.unpacked(p.pa.array([p.sketch(s)], p.pa.binary())) for s in (a, b))
    assert not p.linked(a, b, 80) and p.possible((one[0], two[0]), (one[1], two[1]), 80).all()  # the 512 parities let it pass
    assert crossing_rows(spark, [a, b])[1].count() == 0
