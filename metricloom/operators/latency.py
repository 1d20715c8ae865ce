"""Operational metrics over the request log (method, started_at, ended_at, duration_s, code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from metricloom.schemas import RPC_BUCKETS

_INF = float("inf")


def latency_histogram(
    log: DataFrame, buckets: list[float] | None = None, by: tuple[str, ...] = ("method",), window: str | None = None
) -> DataFrame:
    """Cumulative histogram in long form: ``(*by, window_start?, le, cumulative, count, sum)``.

    One aggregate row per group holds all buckets and is unfolded afterwards. The last bucket is infinity.
    """
    bounds = [*(buckets or RPC_BUCKETS), _INF]
    keys = [F.col(c) for c in by]
    if window:
        keys.append(F.window("ended_at", window)["start"].alias("window_start"))
    wide = log.groupBy(*keys).agg(
        *[F.count_if(F.col("duration_s") <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("duration_s").alias("count"),
        F.sum("duration_s").alias("sum"),
    )
    cells = [
        F.struct(F.lit(b).cast("double").alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    names = [*by, *(["window_start"] if window else [])]
    return wide.select(*names, F.explode(F.array(*cells)).alias("_c"), "count", "sum").select(
        *names, "_c.le", "_c.cumulative", "count", "sum"
    )


def quantile_from_buckets(histogram: DataFrame, q: float = 0.99, by: tuple[str, ...] = ("window_start",)) -> DataFrame:
    """Quantile estimated inside the bucket that holds the rank, ``(*by, quantile)``.

    Buckets of the remaining dimensions are added up first. A rank in the infinite bucket gives the last
    finite bound; the first bucket starts at 0. Groups here have one row per bucket bound.
    """
    le_order = Window.partitionBy(*by).orderBy("le")
    merged = histogram.groupBy(*by, "le").agg(F.sum("cumulative").alias("cumulative"))
    ranked = merged.select(
        *by,
        "le",
        "cumulative",
        F.coalesce(F.lag("le").over(le_order), F.lit(0.0)).alias("_lower"),
        F.coalesce(F.lag("cumulative").over(le_order), F.lit(0)).alias("_below"),
        (F.max("cumulative").over(Window.partitionBy(*by)) * F.lit(q)).alias("_rank"),
    )
    # rank 0 lies at the lower end of the first bucket that holds anything
    above = (F.col("_rank") > F.col("_below")) | ((F.col("_rank") == 0) & (F.col("_below") == 0) & (F.col("cumulative") > 0))
    inside = ranked.filter((F.col("_rank") <= F.col("cumulative")) & above)
    share = F.try_divide(F.col("_rank") - F.col("_below"), (F.col("cumulative") - F.col("_below")).cast("double"))
    value = F.when(F.col("le") == _INF, F.col("_lower")).otherwise(
        F.col("_lower") + (F.col("le") - F.col("_lower")) * share
    )
    return inside.select(*by, value.alias("quantile"))


# Width in nanoseconds of the coarse slots of the exact quantiles, about 4 ms.
_SLOT_NS = 1 << 22


def exact_quantiles(log: DataFrame, probabilities: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact interpolated quantiles of ``duration_s``, ``(*by, probability, value)``.

    Durations are counted as whole nanoseconds, first per value and then per slot of about 4 ms. The slots
    tell in which one a rank lies, and only those slots are read in order. So the ordered work of one task
    is bounded by the clock resolution: at most 2^22 distinct values in a slot, and the longest duration over
    4 ms slots per group, whatever the number of log rows.
    """
    by = tuple(by)
    counts = (
        log.filter("duration_s is not null")
        .groupBy(*by, F.round(F.col("duration_s") * 1e9).cast("bigint").alias("ns"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("slot", F.call_function("div", F.col("ns"), F.lit(_SLOT_NS).cast("bigint")))
    )
    # A constant partition key keeps a total report (no ``by``) on the same plan as a grouped one.
    group = [*by, F.lit(0)]
    before = Window.partitionBy(*group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        counts.groupBy(*by, "slot")
        .agg(F.sum("n").alias("slot_n"))
        .withColumn("slot_before", F.coalesce(F.sum("slot_n").over(before), F.lit(0)))
        .withColumn("total", F.sum("slot_n").over(Window.partitionBy(*group)))
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    position = F.col("probability") * (F.col("total") - 1)
    targets = (
        slots.withColumn("probability", wanted)
        .withColumn("_side", F.explode(F.array(F.floor(position), F.ceil(position))))
        .filter((F.col("_side") >= F.col("slot_before")) & (F.col("_side") < F.col("slot_before") + F.col("slot_n")))
        .withColumn("_position", position)
        .select(*by, "slot", "slot_before", "probability", "_side", "_position")
    )
    in_slot = Window.partitionBy(*by, "slot").orderBy("ns").rowsBetween(Window.unboundedPreceding, -1)
    needed = targets.select(*by, "slot").distinct()
    ordered = counts.join(needed, [*by, "slot"], "left_semi").withColumn(
        "_below", F.coalesce(F.sum("n").over(in_slot), F.lit(0))
    )
    rank = F.col("_side") - F.col("slot_before")
    found = targets.join(ordered, [*by, "slot"]).filter((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("n")))
    lower, upper = F.min("ns"), F.max("ns")
    share = F.max(F.col("_position") - F.floor("_position"))
    return found.groupBy(*by, "probability").agg(((lower + (upper - lower) * share) / 1e9).alias("value"))


def inflight(log: DataFrame, bucket: str = "1 minute") -> DataFrame:
    """Requests started and not yet ended at the end of each time slot.

    The running sum is over one row per slot that saw a change (43,200 a month at a minute), not over the log.
    """
    slot = F.window(F.col("_e")["at"], bucket)["start"]
    events = log.select(
        F.explode(
            F.array(
                F.struct(F.col("started_at").alias("at"), F.lit(1).alias("delta")),
                F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("delta")),
            )
        ).alias("_e")
    ).filter(F.col("_e")["at"].isNotNull())
    per_slot = events.groupBy(slot.alias("bucket_start")).agg(F.sum(F.col("_e")["delta"]).alias("delta"))
    running = Window.partitionBy(F.lit(0)).orderBy("bucket_start").rowsBetween(Window.unboundedPreceding, 0)
    return per_slot.select("bucket_start", F.sum("delta").over(running).alias("inflight"))


def load_report(log: DataFrame, probabilities: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Load report as ``(section, metric, value)``: totals, latency quantiles and the status distribution."""
    seconds = (F.unix_micros(F.max("ended_at")) - F.unix_micros(F.min("started_at"))) / F.lit(1e6)
    totals = log.agg(
        F.count("duration_s").cast("double").alias("count"),
        seconds.alias("total"),
        F.avg("duration_s").alias("average"),
        F.min("duration_s").alias("fastest"),
        F.max("duration_s").alias("slowest"),
        F.try_divide(F.count("duration_s").cast("double"), seconds).alias("rps"),
    )
    summary = totals.unpivot([], ["count", "total", "average", "fastest", "slowest", "rps"], "metric", "value")
    quantiles = exact_quantiles(log, list(probabilities)).select(
        F.concat(F.lit("p"), F.round(F.col("probability") * 100, 3).cast("decimal(9,3)").cast("double").cast("string"))
        .alias("metric"),
        "value",
    )
    codes = log.groupBy(F.col("code").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts = [
        part.select(F.lit(section).alias("section"), "metric", "value")
        for section, part in (("summary", summary), ("latency", quantiles), ("status", codes))
    ]
    return reduce(DataFrame.unionByName, parts)


def golden_signals(log: DataFrame, window: str = "1 minute") -> DataFrame:
    """Handled requests by window, method and code, with the error rate of the window and method."""
    handled = log.groupBy(F.window("ended_at", window)["start"].alias("window_start"), "method", "code").agg(
        F.count(F.lit(1)).alias("handled")
    )
    whole = Window.partitionBy("window_start", "method")
    errors = F.sum(F.when(F.col("code") != "OK", F.col("handled")).otherwise(0)).over(whole)
    return handled.withColumn("error_rate", errors / F.sum("handled").over(whole))


def message_totals(marked: DataFrame) -> DataFrame:
    """Messages received and sent per fleet: every frame is answered by an ack, an anomaly also by an alert."""
    alerts = F.count_if(F.col("is_anomaly") & ~F.col("is_duplicate"))
    return marked.groupBy("fleet_id").agg(
        F.count(F.lit(1)).alias("received"), (F.count(F.lit(1)) + alerts).alias("sent")
    )
