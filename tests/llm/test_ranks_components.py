import random

import pytest
from pyspark.sql import functions as F

from metricloom.llm.components import stars
from metricloom.llm.ranks import running_sum


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sum_equals_brute_force(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i % 37, i, rng.randrange(5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, o int, id int, v long").repartition(partitions)
    got = running_sum(frame, ["g"], ["o", "id"], F.col("v"), "before").collect()
    assert len(got) == 500
    for row in got:
        want = sum(v for g, o, i, v in rows if g == row.g and (o, i) < (row.o, row.id))
        assert row.before == want


def test_running_sum_of_nothing(spark):
    frame = spark.createDataFrame([], "g string, o int, v long")
    assert running_sum(frame, ["g"], ["o"], F.col("v"), "before").collect() == []


def find(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(root)}


@pytest.mark.parametrize("seed", range(3))
def test_stars_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [tuple(sorted(rng.sample(range(-200, 200), 2), reverse=True)) for _ in range(170)]
    pairs += [(i + 1, i) for i in range(1000, 1040)]  # a long path
    pairs += [(5000 + i, 4999) for i in range(60)]  # a star
    got = {r.node: r.root for r in stars(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = find(pairs)
    assert got == {x: r for x, r in want.items() if x != r}


def test_stars_of_nothing(spark):
    assert stars(spark.createDataFrame([], "a long, b long")).collect() == []
