import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import mixing, pu, quality, shard_tree
from metricloom.llm.tables import table
from tests.llm import test_decontaminate, test_descent, test_simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_stages_equal_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns, tables = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        tables.append(docs)
    first, good, single, clean, mix, last = [
        {r.doc_id: r.text for r in t.collect()} for t in [table(spark, FOLDER, "documents"), *tables]
    ]
    assert [t.columns for t in tables[:4]] == [columns] * 4
    assert len(first) > len(single) > len(clean) > 20 and last.keys() == mix.keys()

    labels = table(spark, FOLDER, "labels").filter(pu.remainder("doc_id", 5) != 0)
    output = quality.outputs(quality.train(table(spark, FOLDER, "documents"), labels))
    assert good.keys() == {i for i, t in first.items() if pu.sigmoid(output(t.encode())) >= pu.CUT}

    prints = [(i, test_simhash.brute(t)) for i, t in good.items()]
    assert single.keys() == {i for (i, _), c in zip(prints, test_simhash.components(prints)) if i == c}

    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    assert clean.keys() == {i for i, t in single.items() if not test_decontaminate.brute(t, items)[1]}

    taken = mixing.copies(mixing.sized(tables[2])).filter("copies > 0").collect()
    counts = {r.doc_id: r["count"] for r in tables[3].groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in taken} and mix.keys() == counts.keys()

    placed, tree = tables[4].select("doc_id", "region", "rack", "shard").collect(), shard_tree.even_tree(8)
    assert all((r.region, r.rack, r.shard) == test_descent.slow_descent(r.doc_id, tree) for r in placed)
    assert len(placed) == tables[3].count()


def test_odd_rows_go_through(spark):
    rows = [(1, "some words here", "en", "a", 3), (1, "some words here", "en", "a", 3), (None, None, None, None, None), (3, "", "en", None, 0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.select(F.count("*")).first()[0] <= 3 * len(given)


def test_near_duplicates_do_not_broadcast_a_row_per_document(spark):
    """Documents, fingerprints and links are joined by merges, however small their files are; what is kept may be sized as it is shuffled."""
    docs = spark.createDataFrame([(i, f"a b c {i}", "en", "web", 7) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = corpus_pipeline.near_duplicates(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 3  # documents with components; fingerprints with their roots, twice
