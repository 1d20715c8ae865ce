"""As-of lookup: for each left row the last right row at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from metricloom.functions.keys import interval_micros, time_bucket


def asof_last(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_time: str,
    right_time: str,
    values: list[str],
    tie_break: str,
    bucket: str = "1 hour",
) -> DataFrame:
    """Left rows with ``values`` of the latest right row, all null when there is none.

    A right row at the very time of a left row counts; among right rows of one time the greatest
    ``tie_break`` wins.

    Both sides are laid in one time line and read in order, so no pairs are formed. A key is cut into time
    slots: inside a slot a running window finds the answer, and rows before the slot's first right row take
    the last value of an earlier slot, found on the per-slot summary (one row per key and slot). A hot key
    is therefore spread over its slots; choose a shorter ``bucket`` for busier keys.
    """
    width = interval_micros(bucket)
    payload = F.struct(*[F.col(c) for c in left.columns])
    value = F.struct(*[F.col(c) for c in values])
    lefts = left.select(
        F.col(on).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), payload.alias("_row")
    )
    rights = right.select(
        F.col(on).alias("_k"),
        F.col(right_time).alias("_t"),
        F.lit(0).alias("_side"),
        F.col(tie_break).alias("_o"),
        value.alias("_v"),
    )
    slot = time_bucket(F.col("_t"), width).alias("_b")
    lefts, rights = lefts.select("*", slot), rights.select("*", slot)
    # One row per slot with right rows (their last value) and one per slot with left rows (none), the latter
    # first, so that it only looks at earlier slots.
    last_values = rights.groupBy("_k", "_b").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_last"))
    asking = lefts.select("_k", "_b").distinct().withColumn("_asks", F.lit(True))
    earlier = Window.partitionBy("_k").orderBy("_b", F.desc_nulls_last("_asks")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        last_values.unionByName(asking, allowMissingColumns=True)
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .filter("_asks")
        .select("_k", "_b", "_carry")
    )
    line = lefts.unionByName(rights, allowMissingColumns=True)
    so_far = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("_hit", F.last("_v", ignorenulls=True).over(so_far)).filter(F.col("_row").isNotNull())
    answer = F.coalesce("_hit", "_carry")
    return found.join(carried, ["_k", "_b"], "left").select(
        "_row.*", *[answer[name].alias(name) for name in values]
    )
