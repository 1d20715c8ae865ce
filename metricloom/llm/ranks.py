"""Running sums over ordered groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricloom.llm.tables import settle, unused


def running_sum(rows: DataFrame, groups: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over the rows of the same group that come before in ``order``.

    Rows are range-partitioned by group and order, so a large group spans many tasks. Each task sums its own
    rows; the sums of earlier tasks are added from one small row per task and group. The result follows from
    the order alone, not from where the ranges were cut, if ``order`` is total. Null groups and null order
    values count as values (nulls come first). Rows that tie in ``order`` get the places in any order.
    """
    mark = unused(rows, name)
    amount_, part, sum_, before, inside, own = (mark + n for n in ("amount", "part", "sum", "before", "inside", "own_part"))
    parts = rows.withColumn(amount_, amount).repartitionByRange(*groups, *order)
    parts = settle(parts.withColumn(part, F.spark_partition_id()), "ranges")
    earlier = Window.unboundedPreceding, -1
    sums = parts.groupBy(*groups, part).agg(F.sum(amount_).alias(sum_))
    across = Window.partitionBy(*groups).orderBy(part).rowsBetween(*earlier)
    names = {g: f"{mark}g{i}" for i, g in enumerate(groups)}
    sums = sums.select(
        F.col(part).alias(own),
        *[F.col(g).alias(new) for g, new in names.items()],
        F.coalesce(F.sum(sum_).over(across), F.lit(0)).alias(before),
    )
    same = parts[part] == sums[own]
    for g, new in names.items():
        same = same & parts[g].eqNullSafe(sums[new])
    within = Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(*earlier)
    summed = parts.withColumn(inside, F.coalesce(F.sum(amount_).over(within), F.lit(0)))
    joined = summed.join(sums, same).withColumn(name, F.col(inside) + F.col(before))
    return joined.drop(amount_, part, own, before, inside, *names.values())
