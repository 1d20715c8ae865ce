import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from metricloom.llm import sketches as sk


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        h = h - (1 << 64) if h >> 63 else h
        h &= (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


def word_hash(word):
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def shingles(text, size=5):
    h = [word_hash(w) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if len(h) < size:
        return {chain(h)} if h else set()
    return {chain(h[i : i + size]) for i in range(len(h) - size + 1)}


def brute(text, k=64):
    return sorted(shingles(text))[:k]


def likeness(a, b, k=64):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else sum(x in a and x in b for x in union) / len(union)


def text_of(sketch):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in sketch)


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "É x"]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 200)))) for i in range(40)]
    return rows + [(2, ""), (4, None), (5, "a"), (7, "one two three four five six"), (8, " \t\n")]


def test_equal_to_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, id int")
    got = {r.doc_id: r for r in sk.edited_likeness(docs).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(order)
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, there = brute(text), brute(edited), brute(after)
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(own), text_of(other))
        assert (r.near_edited, r.near_next) == (likeness(own, other), likeness(own, there))


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f")] * 3 + [(None, "x y z")] * 2 + [(1, "other text")]
    got = sk.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and len({tuple(r) for r in got}) == 3
    assert sk.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = sk.edited_likeness(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(6)
    a = " ".join(rng.choices([f"w{i}" for i in range(500)], k=3000))
    b = a[: len(a) // 2] + " " + " ".join(rng.choices([f"v{i}" for i in range(500)], k=800))
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = sk.sketch(F.col("a"), 512), sk.sketch(F.col("b"), 512)
    r = frame.select(
        sk.merge(x, y, 512).alias("merged"),
        sk.resemblance(x, y, 512).alias("near"),
        sk.containment(y, x, 512).alias("inside"),
        sk.distinct_shingles(x, 512).alias("n"),
    ).first()
    sa, sb = shingles(a), shingles(b)
    assert r.merged == sorted(sa | sb)[:512]
    assert abs(r.near - len(sa & sb) / len(sa | sb)) < 0.08
    assert abs(r.inside - len(sa & sb) / len(sb)) < 0.15
    assert abs(r.n / len(sa) - 1) < 0.15
    short = spark.createDataFrame([("a b c", "")], "a string, b string")
    r = short.select(sk.distinct_shingles(sk.sketch("a")).alias("n"), sk.containment(sk.sketch("b"), sk.sketch("a")).alias("c")).first()
    assert (r.n, r.c) == (1.0, 1.0)


def test_sketches_of_groups(spark):
    rows = [(i % 2, t or "") for i, t in corpus()]
    made = spark.createDataFrame(rows, "g int, text string").select("g", sk.sketch(F.col("text")).alias("s"))
    got = {r.g: r.s for r in sk.merge_rows(made, ["g"], "s").collect()}
    for g in (0, 1):
        assert got[g] == sorted(set().union(*(shingles(t) for x, t in rows if x == g)))[:64]
