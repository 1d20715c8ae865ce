"""Quantile sketches of request durations: one per minute and method, stored, and merged to any longer span.

A sketch (KLL, a built-in aggregate) has a bounded size whatever it has seen, and sketches of parts merge to the sketch of the
whole. So a quantile over a month reads one small row per minute and method instead of the log. With ``K`` the rank of an answer is
off by at most ``RANK_ERROR`` of all requests, short of a chance far below one in a million (the error of a single answer is 0.4 % with
99 % confidence); spans of fewer than ``K`` requests are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.functions.keys import utc_date

K = 800
RANK_ERROR = 0.0133


def sketch_log(log: DataFrame, by: tuple[str, ...] = ("method",), window: str = "1 minute", k: int = K) -> DataFrame:
    """``(*by, window_start, n, sketch)`` of the durations of requests that ended in each window; made in part before the exchange."""
    start = F.window("ended_at", window)["start"].alias("window_start")
    rows = log.filter("duration_s is not null").groupBy(*by, start)
    return rows.agg(F.count("duration_s").alias("n"), F.kll_sketch_agg_double("duration_s", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, window: str | None, by: tuple[str, ...] = ("method",), k: int = K) -> DataFrame:
    """Sketches of longer windows, or without a window of the whole time (then without ``window_start``)."""
    start = [F.window("window_start", window)["start"].alias("window_start")] if window else []
    return sketches.groupBy(*by, *start).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """The columns of ``sketches`` without the sketch, with ``probability`` and ``value``; a row per probability."""
    answers = [
        F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
        for p in probabilities
    ]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.inline(F.array(*answers)))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Append sketches to a table partitioned by date; the rows of a minute may come in several writes."""
    rows = sketches.withColumn("sketch_date", utc_date(F.col("window_start"))).hint("rebalance", "sketch_date")
    rows.write.mode("append").partitionBy("sketch_date").parquet(path)


def read_sketches(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored sketches, of the dates ``first`` to ``last`` if given: only their folders are read."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col("sketch_date") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.filter(F.col("sketch_date") <= F.lit(last).cast("date"))
    return rows.drop("sketch_date")


def rank_errors(found: DataFrame, log: DataFrame, window: str, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Quantiles with ``rank_error``: how far, as a share of all requests, their place in the log is from the one asked for."""
    keys = [*by, "window_start"]
    start = F.window("ended_at", window)["start"].alias("window_start")
    rows = log.filter("duration_s is not null").select(*by, start, "duration_s").join(found, keys)
    rows = rows.groupBy(*found.columns).agg(
        (F.count_if(F.col("duration_s") < F.col("value")) / F.count("*")).alias("below"),
        (F.count_if(F.col("duration_s") <= F.col("value")) / F.count("*")).alias("upto"),
    )
    p = F.col("probability")
    return rows.withColumn("rank_error", F.greatest(F.col("below") - p, p - F.col("upto"), F.lit(0.0))).drop("below", "upto")
