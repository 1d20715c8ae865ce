"""The Jaccard join against all pairs, its signatures against their promise, and odd inputs."""

import os
import random

import numpy as np
import pytest

from metricloom.llm import partenum
from metricloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text, words=5):
    tokens = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not tokens:
        return frozenset()
    return frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1)))


def slow(docs, words=5, percent=80):
    """Rows (doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingle_set(t, words) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and sets[j] and 100 * same >= percent * (len(a) + len(sets[j]) - same):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(doc_id)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    rows = [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]
    return sorted(rows, key=str)


def found(spark, docs, **options):
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    return sorted((tuple(r) for r in partenum.near_sets(rows, **options).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        place = rng.randrange(len(words) + 1)
        kind = rng.randrange(3)
        if kind == 0 and words:
            words[place % len(words)] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(place, f"e{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[place % len(words)]
    return words


def corpus(rng, groups, sizes):
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            docs.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 22)))))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_linked_sets_share_a_signature():
    rng, ends = np.random.default_rng(5), partenum.band_ends(3000, 80)
    close = 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 40, 100, 300]))
        base = rng.integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2)
        lost, won = rng.integers(0, n // 5 + 2), rng.integers(0, n // 5 + 2)
        a = np.unique(base)
        b = np.unique(np.concatenate([a[lost:] if rng.random() < 0.5 else rng.permutation(a)[lost:], rng.integers(0, 2**63, won, np.int64).astype(np.uint64)]))
        if partenum.linked(a, b, 80):
            close += 1
            assert np.intersect1d(partenum.signatures(a, ends, 80), partenum.signatures(b, ends, 80)).size
            sizes, parities = zip(*(partenum.unpacked(partenum.pa.array([partenum.sketch(s)])) for s in (a, b)))
            assert partenum.possible(sizes, parities, 80).all()
    assert close > 500


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_signatures_at_the_very_limit(percent):
    """Pairs that only just link, the differences spread as evenly as chance has it."""
    rng, ends = np.random.default_rng(6), partenum.band_ends(2000, percent)
    for _ in range(600):
        n = int(rng.integers(1, 400))
        every = np.unique(rng.integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        gone = len(every) * (100 - percent) // 100
        cut = int(rng.integers(0, gone + 1))
        order = rng.permutation(len(every))
        a, b = np.sort(every[order[cut:]]), np.sort(every[order[: len(every) - (gone - cut)]])
        if partenum.linked(a, b, percent):
            assert np.intersect1d(partenum.signatures(a, ends, percent), partenum.signatures(b, ends, percent)).size


def test_components_equal_all_pairs(spark):
    docs = corpus(random.Random(9), 60, [3, 5, 6, 8, 12, 30, 80, 200])
    rows = found(spark, docs)
    assert rows == slow(docs)
    assert len({r[2] for r in rows}) < len(rows)


def test_chunks_of_large_buckets_meet(spark, monkeypatch):
    monkeypatch.setattr(partenum, "CHUNK", 3)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(edited(rng, base, rng.randint(0, 4)))) for i in range(60)]
    assert found(spark, docs) == slow(docs)


def test_odd_inputs(spark):
    docs = [(1, None), (2, ""), (3, " \t "), (None, None), (4, "One two"), (5, "one  TWO"), (None, "one two"), (6, "one two three")]
    docs += [(7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "z y x w v u"), (8, "É b c d e"), (9, "é b c d e")]
    docs += [(None, "only here of all words"), (20, "x " * 20000), (21, "x " * 9), (22, " ".join(f"w{i}" for i in range(12000)))]
    docs += [(23, " ".join(f"w{i}" for i in range(11000)))]
    assert found(spark, docs) == slow(docs)
    assert partenum.near_sets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    clash = spark.createDataFrame([("b", "x y", 1, 2, 3), ("a", "X y", 1, 2, 3)], "doc_id string, text string, h1 int, node int, root int")
    assert {tuple(r) for r in partenum.near_sets(clash).collect()} == {("a", 1, "a"), ("b", 1, "a")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_partenum"](spark, FOLDER).collect()), key=str) == slow(docs)
