"""Ranked search against scoring every document, and odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np

from metricloom.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def slow(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score) by scoring everything."""
    words = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, n_words = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    tallies = [(doc_id, len(w), Counter(w)) for doc_id, w in words]
    rows = []
    for item_id, text in set(items):
        scored = []
        for doc_id, n, tally in tallies:
            score = 0
            for t in terms(text):
                if t in tally:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * (10**9 * tally[t] // (1000 * tally[t] + 8 * (25 + 75 * n * n_docs // n_words)))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1):
            rows.append((item_id, rank, doc_id, -score))
    return sorted(rows, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in ranked.search(docs, items, **options).collect()), key=str)


def corpus(rng, n, kinds=60):
    vocabulary = [f"w{i}" for i in range(kinds)]
    weights = [1 / (i + 1) for i in range(kinds)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 20, 60, 400])))) for i in range(n)]


def test_ranks_equal_scoring_everything(spark):
    rng = random.Random(3)
    docs, items = corpus(rng, 300), [(i, text) for i, (_, text) in enumerate(corpus(rng, 12))] + [(50, "nothing here"), (51, "w59 W59 w0")]
    assert found(spark, docs, items) == slow(docs, items)
    assert found(spark, docs, items, block_words=40) == slow(docs, items)  # several blocks of queries


def test_bounds_are_never_below_the_score():
    rng = random.Random(4)
    docs = [(i, t) for i, t in corpus(rng, 120) if t]
    vocabulary = sorted({t for _, text in docs for t in terms(text)})
    queries = {k: rng.choices(vocabulary, k=8) for k in range(5)}
    sizes = np.array([len(terms(t)) for _, t in docs])
    asked = ranked.Queries({t: rng.randint(0, 9000) for t in vocabulary}, queries, len(docs), int(sizes.sum()))
    for bits in (16, 256, 8192):
        signatures = []
        for _, text in docs:
            tally = Counter(t.encode() for t in terms(text))
            entries = [
                ranked.mixed(np.array([ranked.xxhash.xxh64_intdigest(t)], np.uint64), level)
                for t, tf in tally.items() for level in ranked.LEVELS if tf >= level
            ]
            signatures.append(ranked.places(np.concatenate(entries), bits).reshape(-1))
        bounds = asked.bounds(bits, ranked.sliced(signatures, bits), sizes)
        for d, (_, text) in enumerate(docs):
            tally = Counter(t.encode() for t in terms(text))
            scores = [asked.score(q, tally, int(sizes[d])) for q in asked.numbers.tolist()]
            assert all(b >= s for b, s in zip(bounds[:, d], scores))


def test_odd_inputs(spark):
    docs = [(None, "Öl Tank tank"), (1, None), (2, ""), (3, "!!! ---"), (4, "tank"), (4, "tank"), (4, "other words öl"), (5, "tank " * 30000)]
    docs += [(9, "copy of this")] * 25
    items = [(1, "TANK"), (1, "TANK"), (1, "öl Öl"), (2, None), (3, ""), (None, "copy"), (7, "...")]
    assert found(spark, docs, items) == slow(docs, items)
    assert sum(r[0] is None for r in found(spark, docs, items)) == 10  # copies fill the ranks
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "tank", 5)], "item_id bigint, text string, query int")
    assert ranked.search(none, some).count() == 0
    texts = spark.createDataFrame([("a", "tank", 1, "x"), ("b", "tank", 2, "y")], "doc_id string, text string, h int, rank string")
    assert [r.doc_id for r in ranked.search(texts, some).orderBy("rank").collect()] == ["a", "b"]
    assert ranked.search(texts, some.filter("false")).count() == 0
    assert ranked.search(texts, some, index=ranked.build_index(texts)).count() == 2
