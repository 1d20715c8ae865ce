"""Output tables of the streaming jobs, laid out as ``<path>/batch_id=<n>/``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a finished job wrote this folder."""
    fs, marker = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Write one micro-batch's part of a table once.

    A replay of the batch finds the finished folder and leaves it, so readers that follow the table as a
    stream never see its rows again under new file names; an unfinished folder is replaced.
    """
    target = batch_path(path, batch_id)
    if committed(df.sparkSession, target):
        return
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)


def read_snapshot(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """Table of which every batch holds a full copy, as of ``batch_id``; empty before the first batch."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_path(path, batch_id))


def latest_batch(spark: SparkSession, path: str) -> int:
    """Newest finished batch of a table, -1 when there is none."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return -1
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    ids = [int(name.split("=")[1]) for name in names if name.startswith("batch_id=")]
    return max((n for n in ids if committed(spark, batch_path(path, n))), default=-1)


def drop_snapshot(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete a full copy that no replay can need any more."""
    if batch_id >= 0:
        fs, target = _fs(spark, batch_path(path, batch_id))
        fs.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of the caller's own."""
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder."""
    fs, target = _fs(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(target)]
