"""Reading driver tables, and cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.session import fresh_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; what is written there goes when the session ends."""
    path = fresh_dir(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settle(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` below ``spark.checkpoint.dir`` and read them back.

    The files outlive any executor, so nothing before them is computed again. They go when the session ends.
    """
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def unused(rows: DataFrame, *more: str) -> str:
    """Beginning for names of helper columns: no column of ``rows`` (nor ``more``) starts with it, in any case."""
    names, mark = [n.lower() for n in [*rows.columns, *more]], "_"
    while any(n.startswith(mark) for n in names):
        mark += "_"
    return mark
