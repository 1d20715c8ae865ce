"""Non-negative positive-unlabelled learning of a logistic model on sparse binary features, in numpy.

The risk of a classifier is estimated without negatives: with class prior p, positives P and unlabelled rows U,
``p * mean_P loss(+) + max(0, mean_U loss(-) - p * mean_P loss(-))``. The second part estimates the risk on negatives, which
cannot be below zero; where a flexible model drives the estimate there, it is raised again with strength ``gamma``
(non-negative correction). The loss is logistic, so the sigmoid of the model's output estimates the probability of the
positive class.

The model is fitted on the driver from a bounded sample (``positives`` and ``unlabelled`` rows in expectation, picked by a
hash of the id); the prior is estimated from all labels, and every row is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from metricloom.llm.tables import settle

#: Names of features are hashed into so many numbers.
WIDTH = 1 << 20
#: Sample sizes (expected): positives with a label, and unlabelled rows.
POSITIVES, UNLABELLED = 4000, 8000
CUT = 0.3

#: Maps UTF-8 text to feature places, each once.
Featurizer = Callable[[bytes], list[int]]


def place(feature: bytes) -> int:
    return zlib.crc32(feature) & (WIDTH - 1)


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


@dataclass
class Model:
    """Weights by place, sorted; ``bias`` is the output without any feature."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> dict[int, float]:
        return dict(zip(self.places.tolist(), self.weights.tolist()))


@dataclass
class Rows:
    """Features of many rows as numbers from 0, one row after another, and where each row begins."""

    numbers: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(rows: list[list[int]]) -> Rows:
        joined = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
        return Rows(joined, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    @staticmethod
    def of_arrow(column: pa.ListArray) -> Rows:
        offsets = column.offsets.to_numpy().astype(np.int64)
        return Rows(column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def outputs(self, weights: np.ndarray, bias: float) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(weights[self.numbers]))
        return bias + sums[self.starts[1:]] - sums[self.starts[:-1]]

    def gradient(self, slopes: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.numbers, np.repeat(slopes, np.diff(self.starts)), width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(
    p: Rows, u: Rows, known: np.ndarray, prior: float, rounds: int = 150, rate: float = 0.1, decay: float = 3e-4, gamma: float = 1.0
) -> Model:
    """Adam steps on the non-negative risk over the whole sample of positives ``p`` and unlabelled rows ``u``; the model is
    the mean of the last third of the steps. ``known`` has the places of the numbered features.

    Without positives or without unlabelled rows the score is the prior everywhere.
    """
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    start, width = float(np.log(prior / (1 - prior))), len(known)
    if not len(p) or not len(u):
        return Model(np.empty(0, np.int64), np.empty(0), start)
    theta, first, second, mean = (np.zeros(width + 1) for _ in range(4))
    theta[-1] = start
    for step in range(1, rounds + 1):
        zp, zu = p.outputs(theta[:-1], theta[-1]), u.outputs(theta[:-1], theta[-1])
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        # slopes of the parts: loss(+) = softplus(-z), loss(-) = softplus(z)
        plus = -prior * sigmoid(-zp) / len(p)
        minus_p, minus_u = -prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        sp, su = (plus + minus_p, minus_u) if negative >= 0 else (plus - gamma * minus_p, -gamma * minus_u)
        slope = np.append(p.gradient(sp, width) + u.gradient(su, width), sp.sum() + su.sum())
        slope[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        mean += theta * (step > rounds - rounds // 3)
    theta = mean / max(1, rounds // 3)
    kept = np.abs(theta[:-1]) > 1e-4
    return Model(known[kept], theta[:-1][kept], float(theta[-1]))


def sample_ids(ids: DataFrame, limit: int, salt: str) -> DataFrame:
    """Distinct ids, about ``limit`` of them, picked by hash; all if there are fewer."""
    ids = ids.filter("doc_id is not null").select("doc_id").distinct()
    share = min(1.0, limit / max(1, ids.count()))
    return ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))


def gather(docs: DataFrame, labels: DataFrame, features: Featurizer, positives: int, unlabelled: int) -> DataFrame:
    """Feature places of the sampled positives (``label`` 1) and unlabelled rows; labels of the latter are not looked at."""
    good = sample_ids(labels.filter("label = 1"), positives, "positive").withColumn("positive", F.lit(True))
    rest = sample_ids(docs, unlabelled, "unlabelled").withColumn("positive", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t or b"")) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "positive", "places"]
            )

    # both sides are bounded by the sample sizes, so the ids fit a broadcast
    ids = F.broadcast(good.union(rest))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "positive", "text").mapInArrow(run, f"doc_id {kind}, positive boolean, places array<int>")
    # of rows that share an id one is enough; it is the same one in every run
    return settle(rows.groupBy("doc_id", "positive").agg(F.min("places").alias("places")), "sample")


def telling(sample: DataFrame, n_p: int, n_u: int, fewest: int, least_share: float, lift: float, prior: float) -> np.ndarray:
    """Places of the features to learn from, ascending.

    Left out are features of fewer than ``fewest`` positives, or than ``least_share`` of them, and those whose share of
    the positives is below ``lift`` times their share of the negatives: what sets positives apart is evidence. The
    unlabelled rows hold ``prior`` of positives; without these, (u - prior * p) / (1 - prior) is the share of the negatives.
    """
    counts = sample.select("positive", F.explode("places").alias("place")).groupBy("place")
    counts = counts.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    often = F.col("p") >= max(fewest, least_share * n_p)
    prior = float(np.clip(prior, 0.0, 1 - 1e-3))
    of_p, of_u = F.col("p") / F.lit(max(1, n_p)), F.col("u") / F.lit(max(1, n_u))
    apart = of_p * F.lit(1 - prior) >= F.lit(float(lift)) * (of_u - F.lit(prior) * of_p)
    return np.sort(counts.filter(often & apart).select("place").toArrow().column(0).to_numpy())


def numbered(sample: DataFrame, known: np.ndarray) -> tuple[Rows, Rows]:
    """The sample's positives and unlabelled rows with the features in ``known`` as numbers, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows.of_arrow(batch.column(2))
            at = np.searchsorted(known, rows.numbers)
            kept = at < len(known)
            kept[kept] = known[at[kept]] == rows.numbers[kept]
            ends = np.append(0, np.cumsum(kept))[rows.starts]
            numbers = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[kept].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], numbers], ["doc_id", "positive", "places"])

    sides = []
    for positive in (True, False):
        rows = sample.filter(F.col("positive") == positive).mapInArrow(run, sample.schema).toArrow().combine_chunks()
        order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
        column = rows.take(pa.array(order)).column("places").combine_chunks()
        sides.append(Rows.of_arrow(column) if len(column) else Rows.of([]))
    return sides[0], sides[1]


def train(
    docs: DataFrame,
    labels: DataFrame,
    features: Featurizer,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    fewest: int = 3,
    least_share: float = 0.0,
    lift: float = 0.0,
    **options: float,
) -> Model:
    """Model from documents and labels (doc_id, ``label`` 0 or 1; only label 1 and the share of 1 are used).

    Features are chosen where the sample is; the driver gets the numbers of chosen ones only.
    """
    prior = labels.agg(F.avg(F.col("label").cast("double"))).first()[0]
    prior = 0.5 if prior is None else prior
    sample = gather(docs, labels, features, positives, unlabelled)
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    known = telling(sample, n_p, n_u, fewest, least_share, lift, prior)
    return fit(*numbered(sample, known), known, prior, **options)


def score(docs: DataFrame, model: Model, outputs: Callable[[Model], Callable[[bytes], float]]) -> DataFrame:
    """Per row doc_id and score; ``outputs`` gives a task the function from text to the model's output."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        output = outputs(shared.value)
        for batch in batches:
            z = np.array([output(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(z))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_scored(docs: DataFrame, model: Model, outputs: Callable[[Model], Callable[[bytes], float]], least: float) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        output = outputs(shared.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            good = sigmoid(np.array([output(t or b"") for t in texts], np.float64)) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def accuracy(scored: pd.DataFrame, truth: str, cut: float = CUT) -> dict[str, float]:
    """Precision and recall of rows with a ``score`` and a 0/1 column ``truth``."""
    hit = (scored["score"] >= cut) & (scored[truth] == 1)
    return {
        "precision": float(hit.sum() / max(1, (scored["score"] >= cut).sum())),
        "recall": float(hit.sum() / max(1, (scored[truth] == 1).sum())),
    }
