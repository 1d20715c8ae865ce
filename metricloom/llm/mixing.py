"""Mix sources to target weights by systematic sampling.

Each source has a target number of words. A document's expected number of copies is the target over the source's size,
the same for all its documents. Their prefix sum along the source, plus one random offset per source, crosses an integer
boundary as often as the document is emitted. Documents go by size, so neighbours are alike and the words taken come
within about one document of the target.

Inputs: a null text has size 0, like an empty one; a null source is a source of its own, the last. A source without words
has target 0 and its documents are not taken. Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricloom.llm.ranks import running_sum
from metricloom.llm.tables import unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CEILING = 3


def words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Per source: source_size and target, from rows with source and size.

    Targets share the sum of all sizes by weight, and stop at ``ceiling`` times the source's size. The level at which the
    rest is shared follows from the sources in order of ceiling over weight: those below the level stop at their ceiling.
    The two windows run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        total.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    every = Window.partitionBy()
    rows = (
        rows.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("share", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("share"), F.col("share"))).over(every))
    )
    target = F.least("most", F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number from [0, 1) per source and seed, in steps of 2^-20."""
    digits = F.substring(F.md5(F.concat(F.lit(f"mix {seed} "), F.coalesce(source, F.lit("(null)")))), 1, 5)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 20))


def copies(sizes: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Add source_size, target, copies and place (in the source, from 0) to rows with doc_id, source, size and ``tie``, which
    orders rows of the same id."""
    ordered = sizes.withColumn("_order", F.md5(F.col("doc_id").cast("string")))
    placed = running_sum(ordered, ["source"], ["size", "_order", "tie"], F.lit(1).cast("long"), "place")
    goal = targets(placed, weights, ceiling).withColumnRenamed("source", "_source")
    rows = placed.join(goal, placed["source"].eqNullSafe(goal["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns({"_rate": rate, "_offset": offset(F.col("source"), seed)})

    def crossed(place: Column) -> Column:
        return F.floor(place * F.col("_rate") + F.col("_offset"))

    emitted = crossed(F.col("place") + 1) - crossed(F.col("place"))
    return rows.withColumn("copies", emitted.cast("long")).drop("_order", "_source", "_rate", "_offset")


def sized(docs: DataFrame) -> DataFrame:
    """What ``copies`` needs of documents."""
    size, tie = words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")
    return docs.select("doc_id", "source", size, tie)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it; columns as before.

    Copies are found on narrow rows and joined back by id and a hash of all columns. Equal rows cannot be told apart,
    so one of them stands for all and comes out with their copies together.
    """
    names, mark = docs.columns, unused(docs)
    keyed = docs.withColumns({f"{mark}row": F.xxhash64(*names), f"{mark}id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    size = words(F.col("text")).alias("size")
    taken = copies(keyed.select("doc_id", "source", size, F.col(f"{mark}row").alias("tie"), f"{mark}id"), seed, weights, ceiling)
    # copies of equal rows are summed up a thousand places at a time, so no row has to come out very often
    parts = taken.groupBy(f"{mark}id", F.col("tie").alias(f"{mark}row"), F.floor(F.col("place") / 1000).alias(f"{mark}part"))
    parts = parts.agg(F.sum("copies").alias(f"{mark}copies")).filter(F.col(f"{mark}copies") > 0)
    joined = keyed.dropDuplicates([f"{mark}id", f"{mark}row"]).join(parts, [f"{mark}id", f"{mark}row"])
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{mark}copies")))
    return joined.withColumn(f"{mark}copy", every).select(*names)
