"""Toxicity by positive-unlabelled learning: confirmed toxic texts against unlabelled ones.

Features are the words of a text and their beginnings, so that inflected and compound words share what they begin with;
each counts again where it is frequent. Inputs: null and empty texts have no features and get the model's bias as score; repeated rows keep a row
each; labels without a document and documents without a label are ignored where labels are learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from metricloom.llm import pu

#: Bytes that beginnings of a word have.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature counts again where it comes up at least so often, and at least once in so many words.
TIMES, ONE_IN = (2, 4), (100, 25)
#: Few features can mark a toxic text: they must be several times as common in them as elsewhere.
OPTIONS = {"lift": 5.0, "fewest": 8, "least_share": 0.015, "decay": 3e-3}
#: Words whose places a task remembers before it begins anew.
REMEMBERED = 1 << 18
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
LEVELS = 1 + len(TIMES) + len(ONE_IN)


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def names(word: bytes) -> list[int]:
    """Numbers of the word itself and of its beginnings."""
    return [pu.place(b"=" + word), *(pu.place(word[:n]) for n in BEGINNINGS if len(word) >= n)]


def reached(found: dict[int, int], total: int) -> Iterator[int]:
    """Places of the levels that names reach by their number of times in a text of ``total`` words."""
    for name, times in found.items():
        first = name * LEVELS
        yield first
        for i, least in enumerate(TIMES, 1):
            if times >= least:
                yield first + i
        for i, most in enumerate(ONE_IN, 1 + len(TIMES)):
            if times * most >= total:
                yield first + i


def features(text: bytes) -> list[int]:
    all_words = words(text)
    found: Counter[int] = Counter()
    for word, times in Counter(all_words).items():
        for name in names(word):
            found[name] += times
    return list(reached(found, len(all_words)))


def outputs(model: pu.Model) -> Callable[[bytes], float]:
    """The model's output for a text; remembers which weighted names a word has."""
    weights = model.lookup()
    weighted = {place // LEVELS for place in weights}
    seen: dict[bytes, tuple[int, ...]] = {}

    def output(text: bytes) -> float:
        all_words = words(text)
        if len(seen) > REMEMBERED:
            seen.clear()
        found: Counter[int] = Counter()
        for word, times in Counter(all_words).items():
            known = seen.get(word)
            if known is None:
                known = seen[word] = tuple(weighted.intersection(names(word)))
            for name in known:
                found[name] += times
        return model.bias + sum(weights.get(p, 0.0) for p in sorted(reached(found, len(all_words))))

    return output


def train(docs: DataFrame, labels: DataFrame, **options: float) -> pu.Model:
    """Model from labels with ``toxic``; only toxic ones and their share are used."""
    return pu.train(docs, labels.select("doc_id", F.col("toxic").alias("label")), features, **{**OPTIONS, **options})


def score(docs: DataFrame, model: pu.Model) -> DataFrame:
    return pu.score(docs, model, outputs)
