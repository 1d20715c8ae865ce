import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from metricloom.llm import simhash
from metricloom.llm.tables import settle


def brute(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def components(prints):
    """ids by fingerprint -> smallest id reachable."""
    ids, bits = [i for i, _ in prints], np.array([f for _, f in prints], np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    labels = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            best = min(labels[j] for j in np.flatnonzero(near[i]))
            if best < labels[i]:
                labels[i], changed = best, True
    out = []
    for i, label in enumerate(labels):
        members = [ids[j] for j in range(len(ids)) if labels[j] == label and ids[j] is not None]
        out.append(min(members) if members else None)
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 120))) for _ in range(60)]
    for text in texts[:30]:
        words = text.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["", None, " \t\n", "One", "one", "Ünï Wörd Ä", "a b c", "A\tB\x0bC", "x " * 5000, texts[0], texts[0]]
    return [(100 - i if i % 9 else 200 + i, t) for i, t in enumerate(texts)] + [(None, "lonely words"), (7, texts[1])]


def test_fingerprints_equal_brute_force(spark):
    rows = corpus()
    got = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.bits & simhash.MASK) for r in got] == [(i, brute(t)) for i, t in rows]


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, bits string, root int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    want = components([(i, brute(t)) for i, t in rows])
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted(
        (str(i), f"{brute(t):016x}", str(c)) for (i, t), c in zip(rows, want)
    )


@pytest.mark.parametrize("bucket_rows", [2048, 16])
def test_links_connect_all_that_are_near(spark, bucket_rows):
    """A dense cloud of fingerprints, in one large bucket and dealt into many chunks."""
    rng = random.Random(5)
    center = rng.getrandbits(64)
    cloud = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(220)}
    cloud |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(simhash.signed(x) for x in cloud)
    frame = spark.createDataFrame([(x,) for x in prints], "bits long")
    for bands in (5, 7):
        found = simhash.links(frame, bands=bands, bucket_rows=bucket_rows).collect()
        assert all(r.a > r.b for r in found)
        root = {x: x for x in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in found:
            a, b = top(r.a), top(r.b)
            root[max(a, b)] = min(a, b)
        want = components([(x, x & simhash.MASK) for x in prints])
        assert [top(x) for x in prints] == want


def test_every_near_pair_shares_a_key_and_passes_the_pivots(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        pairs.append((simhash.signed(a), simhash.signed(a ^ sum(1 << b for b in rng.sample(range(64), 4)))))
    frame = spark.createDataFrame(pairs, "a long, b long")
    keys = F.size(F.array_intersect(simhash.band_keys(F.col("a"), 7, 4), simhash.band_keys(F.col("b"), 7, 4)))
    assert frame.filter(keys == 0).count() == 0
    for r in simhash.references(16):
        for a, b in pairs:
            d = abs(((a & simhash.MASK) ^ r).bit_count() - ((b & simhash.MASK) ^ r).bit_count())
            assert d <= 4


def test_drop_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e", 1), (2, "A b c d e", 2), (2, "A b c d e", 2), (9, "quite another text of words", 3), (None, "a b c d e", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([(2, "A b c d e", 2), (9, "quite another text of words", 3), (None, "a b c d e", 4)], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_id_with_different_texts(spark):
    """The near copy of 3 goes, the other text of 7 stays; both texts of 9 stand alone."""
    near, clean, other = "a b c d e", "quite another text of words", "something else that nobody else has"
    rows = [(3, near), (7, near.upper()), (7, clean), (9, other), (9, "x y z w v u"), (9, other)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect()) == sorted([(3, near), (7, clean), (9, other), (9, "x y z w v u")])


def test_tables_of_a_row_per_key_or_document_are_not_broadcast(spark):
    """Their estimated size leaves out what explode adds and what files save; the adaptive plan does not undo such a broadcast."""
    small = settle(spark.range(20).select(F.col("id").alias("bits")), "prints")  # far below the threshold
    plan = simhash.links(small)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in range(20)], "doc_id long, text string")
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 3  # the join with the roots comes twice
