"""Retention of a dated store in place: whole dates are dropped, and only dates that can have changed are rewritten.

A date whose rows are all past the meta limit goes as a folder. A date is rewritten when a limit runs through it, when a limit has
passed it since the last run, or when files were added since; all others keep their files. What was done is noted in a manifest
below the store (its name begins with an underscore, so readers pass over it), written last: a run that was cut off leaves dates that
the next run finds changed and rewrites again, which gives the same rows.
"""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.functions.keys import utc_date
from metricloom.operators.store import DAY_MS, apply_retention
from metricloom.schemas import META_TTL_DAYS, SYSTEM_TTL_DAYS
from metricloom.session import fresh_dir
from metricloom.sources.store import write_order
from metricloom.streaming.tables import delete_path, list_names, path_exists

MANIFEST = "_retention"


def _stage(day: date, now_ms: int, system_ttl_days: int, meta_ttl_days: int) -> str:
    """How the limits lie to a date: ``gone``, ``old`` and ``fresh`` are wholly on one side, ``crossed`` dates are not."""
    first = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)
    last = first + DAY_MS - 1
    system, meta = now_ms - system_ttl_days * DAY_MS, now_ms - meta_ttl_days * DAY_MS
    if last < meta:
        return "gone"
    if first < meta or first < system <= last:
        return "crossed"
    return "old" if last < system else "fresh"


def _known(spark: SparkSession, path: str) -> dict[date, tuple[str, str]]:
    if not path_exists(spark, f"{path}/{MANIFEST}"):
        return {}
    rows = spark.read.parquet(f"{path}/{MANIFEST}").collect()  # a row per date
    return {r["day"]: (r["stage"], r["files"]) for r in rows}


def _folders(spark: SparkSession, path: str) -> dict[date, str]:
    """Folder per date of the store."""
    names = [n for n in list_names(spark, path) if n.startswith("event_date=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")]
    return {date.fromisoformat(n.split("=", 1)[1]): f"{path}/{n}" for n in names}


def _files(spark: SparkSession, folder: str) -> str:
    return " ".join(sorted(n for n in list_names(spark, folder) if not n.startswith(("_", "."))))


def collect_garbage_in_place(
    spark: SparkSession,
    path: str,
    as_of: datetime,
    system_ttl_days: int = SYSTEM_TTL_DAYS,
    meta_ttl_days: int = META_TTL_DAYS,
    **limits: int,
) -> dict[str, int]:
    """Apply retention to a store partitioned by ``event_date``; how many dates were dropped, rewritten and left alone.

    Afterwards the store holds what ``apply_retention`` leaves of all its rows. One writer at a time; files that are
    appended meanwhile are seen by the next run.
    """
    now_ms = int(as_of.replace(tzinfo=as_of.tzinfo or timezone.utc).timestamp() * 1000)
    known, folders = _known(spark, path), _folders(spark, path)
    stages = {day: _stage(day, now_ms, system_ttl_days, meta_ttl_days) for day in folders}
    gone = [day for day, stage in stages.items() if stage == "gone"]
    changed = [
        day
        for day, stage in stages.items()
        if stage != "gone" and (stage == "crossed" or known.get(day) != (stage, _files(spark, folders[day])))
    ]
    if changed:
        rows = spark.read.option("basePath", path).parquet(*[folders[day] for day in changed])
        kept = apply_retention(rows, as_of, system_ttl_days, meta_ttl_days, order=write_order(rows), **limits).drop("version")
        staged = fresh_dir(spark, "retention")
        _by_date(kept).write.parquet(staged)
        kept = spark.read.schema(_by_date(kept).schema).parquet(staged)
        left = {r["event_date"] for r in kept.select("event_date").distinct().collect()}  # dates, not rows
        clustered = kept.repartitionByRange("event_date", "row_key", "arrival_seq").sortWithinPartitions("event_date", "row_key")
        writer = clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("event_date").parquet(path)
        delete_path(spark, staged)
        gone += [day for day in changed if day not in left]
    for day in gone:
        delete_path(spark, folders[day])
    done = [(day, stages[day], _files(spark, folder)) for day, folder in folders.items() if day not in gone]
    note = spark.createDataFrame(done, "day date, stage string, files string").coalesce(1)
    note.write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    counts = Counter("dropped" if d in gone else "rewritten" if d in changed else "untouched" for d in folders)
    return {name: counts[name] for name in ("dropped", "rewritten", "untouched")}


def _by_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_date", utc_date(F.timestamp_millis("unix_ms")))
