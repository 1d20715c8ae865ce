import random

import numpy as np
import pandas as pd
import pytest

from metricloom.llm import pu, quality, toxicity


def test_risk_needs_no_negatives():
    """Places 0 and 1 mark positives, 2 and 3 negatives; the unlabelled rows mix both."""
    rng = np.random.default_rng(1)

    def rows(n, positive):
        return [np.unique(np.append(rng.choice([0, 1] if positive else [2, 3], 2), rng.integers(4, 30, 6))) for _ in range(n)]

    mixed = rows(300, True) + rows(700, False)
    model = pu.fit(pu.Rows.of(rows(300, True)), pu.Rows.of(mixed), np.arange(30), 0.3)
    outputs = [pu.sigmoid(np.array([sum(model.lookup().get(p, 0) for p in r) + model.bias]))[0] for r in rows(100, True) + rows(100, False)]
    assert min(outputs[:100]) > 0.5 > max(outputs[100:])


def test_nothing_to_learn_from():
    model = pu.fit(pu.Rows.of([]), pu.Rows.of([[0, 1]]), np.arange(2), 0.2)
    assert abs(float(pu.sigmoid(np.array([model.bias]))[0]) - 0.2) < 1e-9


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(8, 80))
        toxic, good = i % 8 == 0, i % 5 != 0
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyone", "vileish", "Grossly"]))
        if not good:
            words = [w + " |" for w in words] if i % 2 else [w for w in words for _ in range(6)]
        docs.append((i, " ".join(words) + ".", 0.5))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    docs += [(n, None, 0.0), (n + 1, "", 0.0), (None, "word1 word2", 0.0), (5, docs[5][1], 0.5), (n + 2, "word3 " * 40_000, 0.0)]
    return docs, labels + [(10**6, 1, 1), (None, 1, 1)]


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for operator, name, parts, held in ((toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)):
        learn = marks.filter(pu.remainder("doc_id", parts) != held)
        model = operator.train(frame, learn)
        again = operator.train(frame.repartition(5), learn)
        assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
        scored = operator.score(frame, model).toPandas()
        assert len(scored) == len(docs) and scored["score"].between(0, 1).all()
        test = marks.filter(pu.remainder("doc_id", parts) == held).toPandas()
        result = pu.accuracy(scored.drop_duplicates().merge(test, on="doc_id"), name)
        assert result["precision"] > 0.9 and result["recall"] > 0.9, (name, result)


def test_good_texts_are_kept_whole(spark):
    docs, labels = corpus(600)
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns
    scored = quality.score(frame, model).toPandas()
    assert kept.count() == int((scored["score"] >= pu.CUT).sum())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for operator in (toxicity, quality):
        assert operator.score(docs, operator.train(docs, labels)).collect() == []
        assert [r.score for r in operator.score(some, operator.train(some, labels)).collect()] == [0.5, 0.5]


def test_sample_is_bounded_and_stable(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    one = {r.doc_id for r in pu.sample_ids(ids, 1000, "x").collect()}
    assert one == {r.doc_id for r in pu.sample_ids(ids.repartition(3), 1000, "x").collect()}
    assert 850 < len(one) < 1150
    assert pd.Series(sorted(one)).diff().max() < 400


@pytest.mark.parametrize("share", [0.05, 0.25, 0.5])
def test_toxic_share_does_not_matter(spark, share):
    rng = random.Random(3)
    docs, marks = [], []
    for i in range(2000):
        words, toxic = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(8, 80))], rng.random() < share
        for _ in range(1 + len(words) // 20 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nastyone", "vileish", "Grossly"]))
        docs.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(frame, labels.filter(pu.remainder("doc_id", 4) != 2))
    test = labels.filter(pu.remainder("doc_id", 4) == 2).toPandas()
    result = pu.accuracy(toxicity.score(frame, model).toPandas().merge(test, on="doc_id"), "toxic")
    assert result["precision"] > 0.9 and result["recall"] > 0.9, result
