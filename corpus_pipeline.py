"""A corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes and returns the columns of documents; the last adds region, rack and shard. Nulls, empty texts, repeated
rows and empty tables go through as the operators' docstrings define: rows without an id are told apart by their text, and are
deduplicated and decontaminated like all others; a document without words is not in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm import decontaminate, mixing, pu, quality, shard_tree, simhash
from metricloom.llm.tables import settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels that op5 learns from."""
    labels = table(spark, folder, "labels").filter(pu.remainder("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, if any has one."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4, keep_unnamed=False)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"), keep_unnamed=False)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each row with its region, rack and shard of eight; copies of a document share a shard."""
    return shard_tree.assign_shards(docs, ["doc_id"], shard_tree.even_tree(8))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: SQL has no trained classifier and no XXH64; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents; the last one's rows are not written."""
    docs = table(spark, folder, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if place + 1 < len(STAGES):
            docs = settle(docs, name.replace(" ", "-"))
    return docs
