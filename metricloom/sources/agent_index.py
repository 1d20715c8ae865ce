"""A second layout of the store, for reads of one agent: by a hash of the agent instead of by date.

A scan of one agent opens the files of one bucket, whatever the span of time; within a bucket files have narrow key ranges, and a Bloom
filter on the agent skips row groups. Every write is a generation of its own below the bucket. A bucket with one generation has
one row per key and is read as it is; only buckets with several are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.operators.store import merge_rows, scan_agent
from metricloom.streaming.tables import list_names, path_exists

BUCKETS = 256


def bucket_of(agent_id: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of an agent. Agents whose names go on after a ``#`` share that of the name before, as a prefix scan finds them all."""
    return F.pmod(F.xxhash64(F.substring_index(agent_id, "#", 1)), F.lit(buckets)).cast("int")


def write_by_agent(rows: DataFrame, path: str, generation: int, buckets: int = BUCKETS) -> None:
    """Write merged store rows (one per key) as a generation; later numbers are later writes. A generation written again is replaced.

    Ranges of (bucket, key) spread an agent that has most rows over many files.
    """
    placed = rows.withColumns({"agent_bucket": bucket_of(F.col("agent_id"), buckets), "generation": F.lit(generation)})
    ranged = placed.repartitionByRange("agent_bucket", "row_key").sortWithinPartitions("agent_bucket", "row_key")
    writer = ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.option("parquet.bloom.filter.enabled#agent_id", "true")
    writer.partitionBy("agent_bucket", "generation").parquet(path)


def read_agent(spark: SparkSession, path: str, agent_id: str, buckets: int = BUCKETS) -> DataFrame:
    """All rows of the agent's bucket, one per key: only that folder is listed and read."""
    number = spark.range(1).select(bucket_of(F.lit(agent_id), buckets)).first()[0]
    folder = f"{path}/agent_bucket={number}"
    if not path_exists(spark, folder):
        return spark.read.parquet(path).drop("agent_bucket", "generation").filter("false")
    generations = [name for name in list_names(spark, folder) if name.startswith("generation=")]
    rows = spark.read.option("basePath", folder).parquet(folder)
    if len(generations) > 1:
        rows = merge_rows(rows, ["generation", "arrival_seq"])
    return rows.drop("generation")


def scan_by_agent(spark: SparkSession, path: str, agent_id: str, n: int, buckets: int = BUCKETS) -> DataFrame:
    """Newest ``n`` rows whose key starts with ``agent#``, as ``scan_agent`` finds them."""
    return scan_agent(read_agent(spark, path, agent_id, buckets), agent_id, n)
