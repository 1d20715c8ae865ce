"""Periodic runs against a search over all periods, and odd inputs."""

import hashlib
import os
import random
import zlib

import pytest

from metricloom.llm import periodic
from metricloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def slow_runs(words):
    """Runs (start, length, period) by trying every period at every place."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                part = words[start : i + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 70)
    words = [b"abcde"[k : k + 1] for k in (rng.randrange(kinds) for _ in range(n))]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 9)
        words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
    return words


def test_runs_equal_all_periods():
    rng = random.Random(7)
    for _ in range(800):
        words = random_words(rng)
        slow = slow_runs(words)
        assert [tuple(r) for r in periodic.runs(words).tolist()] == slow, words
        assert [tuple(r) for r in periodic.tree_runs([w[0] for w in words]).tolist()] == slow, words
        assert periodic.collapsed(words, periodic.runs(words)) == b" ".join(slow_collapsed(words, slow))


def test_extensions_of_the_tree():
    rng = random.Random(8)
    for _ in range(60):
        text = [rng.randint(1, 3) for _ in range(rng.randint(2, 150))]
        depths, at, order, _ = periodic.SuffixTree(text).tour()
        extension = periodic.Extensions(depths, at)
        assert order.tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])
        for _ in range(40):
            a, b = rng.sample(range(len(text)), 2)
            same = 0
            while max(a, b) + same < len(text) and text[a + same] == text[b + same]:
                same += 1
            assert extension(periodic.np.array([a]), periodic.np.array([b])).tolist() == [same]


def test_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(3000)) + " again and" * 2500
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n ", 3), (None, "x " * 6, 4), (5, "x " * 5, 5), (5, "x " * 5, 6), (7, long, 7), (8, "ä b " * 6, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").withColumnRenamed("runs", "n_words")
    found = {}
    for row in periodic.find_runs(docs).collect():
        found.setdefault(row.doc_id, []).append((row.n_words, [tuple(r) for r in row.runs], row.collapsed))
    assert found[1] == [(0, [], None)] and found[2] == [(0, [], "")] and found[3] == [(0, [], "")]
    assert found[None] == [(6, [(0, 6, 1)], "x")]
    assert found[5] == [(5, [], "x x x x x")] * 2
    assert found[7][0][:2] == (8000, [(3000, 5000, 2)]) and found[7][0][2].endswith("w2999 again and")
    assert found[8] == [(6, [(0, 6, 1)], "ä b")]  # other blanks are part of a word
    assert periodic.find_runs(docs.filter("doc_id > 99")).count() == 0
    texts = spark.createDataFrame([("k", "x " * 6)], "doc_id string, text string")
    assert periodic.find_runs(texts).first().doc_id == "k"


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_query_equals_all_periods(spark):
    rows = QUERIES["op13_periodic_runs"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        words = expected(r.doc_id, texts[r.doc_id])
        if len(words) > 800:
            continue  # the slow search takes the square of it
        slow = slow_runs(words)
        best = min(slow, key=lambda s: (-s[1], s[0], s[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(slow), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in slow)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(slow_collapsed(words, slow))).hexdigest()
