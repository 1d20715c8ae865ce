"""Text quality by positive-unlabelled learning: trusted good texts against unlabelled web text.

Features describe the shape of a text (repetition, signs, word lengths), each cut at fixed edges into "at least" steps, so
the linear model can follow any threshold. Inputs: null and empty texts have the features of no words; repeated rows keep a
row each; labels without a document and documents without a label are ignored where labels are learned.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from math import log1p
from operator import eq, ne

from pyspark.sql import DataFrame, functions as F

from metricloom.llm import pu

SHARES = tuple(i / 40 for i in range(1, 41))
LENGTHS = tuple(2.0**i for i in range(17))
SIZES = tuple(float(i) for i in range(1, 31))
SIGNS = b"|%$#&*~^=<>{}[]\\_@+"
POINTS = b".,;:!?'\"()-"
DIGITS = b"0123456789"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Name and edges of each measure.
MEASURES = (
    ("words", LENGTHS),
    ("distinct", SHARES),
    ("again", SHARES),
    ("signs", SHARES),
    ("points", SHARES),
    ("digits", SHARES),
    ("capitals", SHARES),
    ("bare", SHARES),
    ("mean", SIZES),
    ("lines", SHARES),
)
PLACES = tuple(tuple(pu.place(f"{name} {edge}".encode()) for edge in edges) for name, edges in MEASURES)


def measures(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))

    def chars(kinds: bytes) -> int:
        return len(text) - len(text.translate(None, kinds))

    again = sum(map(eq, words, words[1:]))
    signs = chars(SIGNS)
    bare = sum(map(ne, map(bytes.isalpha, words), map(bytes.isascii, words)))
    return (
        len(words),
        log1p(len(set(words))) / log1p(n),
        again / n,
        min(1.0, signs / n),
        min(1.0, chars(POINTS) / n),
        min(1.0, chars(DIGITS) / size),
        min(1.0, chars(CAPITALS) / n),
        bare / n,
        sum(map(len, words)) / n,
        min(1.0, text.count(b"\n") / n),
    )


def features(text: bytes) -> list[int]:
    found: list[int] = []
    for value, (_, edges), places in zip(measures(text), MEASURES, PLACES):
        found += places[: bisect_right(edges, value)]
    return found


def outputs(model: pu.Model) -> Callable[[bytes], float]:
    """The model's output for a text: per measure, the sum of the weights of the steps it has reached."""
    weights = model.lookup()
    sums = []
    for places in PLACES:
        total = [0.0]
        for p in places:
            total.append(total[-1] + weights.get(p, 0.0))
        sums.append(total)

    def output(text: bytes) -> float:
        return model.bias + sum(t[bisect_right(e, v)] for v, (_, e), t in zip(measures(text), MEASURES, sums))

    return output


def train(docs: DataFrame, labels: DataFrame, **options: float) -> pu.Model:
    """Model from labels with ``quality``; only good ones and their share are used."""
    return pu.train(docs, labels.select("doc_id", F.col("quality").alias("label")), features, **options)


def score(docs: DataFrame, model: pu.Model) -> DataFrame:
    return pu.score(docs, model, outputs)


def keep_good(docs: DataFrame, model: pu.Model, least: float = pu.CUT) -> DataFrame:
    """``docs`` without the texts that score below ``least``."""
    return pu.keep_scored(docs, model, outputs, least)
