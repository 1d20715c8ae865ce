"""Rollup of anomalies by date, region and fleet, kept up batch by batch.

The table holds sums and counts, so batches can be added; means are taken when it is read. A batch rewrites only the partitions (date and
region) it has rows for. Every row names the last batch that was added to its partition: a batch that comes again, after a
crash or a rerun, leaves partitions alone that have it already, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.functions.keys import utc_date
from metricloom.functions.metrics import cpu_or_zero
from metricloom.functions.text import label
from metricloom.session import fresh_dir
from metricloom.streaming.tables import delete_path, path_exists

KEYS = ["window_date", "region"]
ROLLUP = "fleet_id string, anomaly_count bigint, cpu_sum double, last_batch bigint, window_date date, region string"
#: Stands for no region in folder names.
NO_REGION = "__none__"


def partial_sums(anomalies: DataFrame, time_col: str = "collected_at") -> DataFrame:
    """Sums and counts of a batch; anomalies without a fleet are dropped."""
    rows = anomalies.filter(F.col("fleet_id") != "").select(
        utc_date(F.col(time_col)).alias("window_date"),
        F.coalesce(label(F.col("labels"), "region"), F.lit(NO_REGION)).alias("region"),
        "fleet_id",
        cpu_or_zero().alias("cpu"),
    )
    return rows.groupBy(*KEYS, "fleet_id").agg(F.count(F.lit(1)).alias("anomaly_count"), F.sum("cpu").alias("cpu_sum"))


def merge_batch(anomalies: DataFrame, batch_id: int, path: str, time_col: str = "collected_at") -> None:
    """Add a batch to the table; batches come in the order of their numbers."""
    spark = anomalies.sparkSession
    columns = [c.split()[0] for c in ROLLUP.split(", ")]
    fresh = partial_sums(anomalies, time_col).withColumn("last_batch", F.lit(batch_id).cast("bigint")).select(*columns)
    staged = fresh_dir(spark, "rollup-batch")
    fresh.write.parquet(f"{staged}/fresh")
    fresh = spark.read.schema(ROLLUP).parquet(f"{staged}/fresh")
    if path_exists(spark, path):
        touched = fresh.select(*KEYS).distinct()
        before = spark.read.schema(ROLLUP).parquet(path).join(touched, KEYS, "left_semi")
        done = before.groupBy(*KEYS).agg(F.max("last_batch").alias("known")).filter(F.col("known") >= batch_id).select(*KEYS)
        fresh = fresh.join(done, KEYS, "left_anti")
        both = fresh.unionByName(before.join(fresh.select(*KEYS).distinct(), KEYS, "left_semi"))
        fresh = both.groupBy(*KEYS, "fleet_id").agg(
            F.sum("anomaly_count").alias("anomaly_count"),
            F.sum("cpu_sum").alias("cpu_sum"),
            F.max("last_batch").alias("last_batch"),
        )
        # a table cannot be overwritten while it is read
        fresh.select(*columns).write.parquet(f"{staged}/merged")
        fresh = spark.read.schema(ROLLUP).parquet(f"{staged}/merged")
    writer = fresh.hint("rebalance", *KEYS).sortWithinPartitions(*KEYS, "fleet_id").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    delete_path(spark, staged)


def run_rollup(
    anomalies: DataFrame, path: str, checkpoint: str, time_col: str = "collected_at", trigger: dict | None = None
) -> StreamingQuery:
    """Keep the rollup up with a stream of anomalies."""
    return (
        anomalies.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, path, time_col))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """window_date, region, fleet_id, anomaly_count and the mean over the anomalies."""
    rows = spark.read.schema(ROLLUP).parquet(path)
    mean = (F.col("cpu_sum") / F.col("anomaly_count")).alias("avg_cpu_during_anomalies")
    region = F.when(F.col("region") != NO_REGION, F.col("region")).alias("region")
    return rows.select("window_date", region, "fleet_id", "anomaly_count", mean)
