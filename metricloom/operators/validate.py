"""Required ids and field checks; bad rows are set aside with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.schemas import REASONS
from metricloom.sources.frames_json import violation


def violations(strict: bool = False) -> Column:
    """List of (field, description). Strict mode adds the CPU range and the collection time."""
    cpu = F.col("system.cpu_utilization_pct")
    checks = [
        F.when(F.coalesce(F.col(name), F.lit("")) == "", violation(name, "is required"))
        for name in ("agent_id", "fleet_id")
    ]
    if strict:
        in_range = F.coalesce(~F.isnan(cpu) & cpu.between(0.0, 100.0), F.lit(True))
        checks.append(F.when(~in_range, violation("system.cpu_utilization_pct", "must be between 0 and 100")))
        checks.append(F.when(F.col("collected_at").isNull(), violation("collected_at", "is required")))
    return F.array_compact(F.array(*checks)).cast(REASONS)


def validate(frames: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)``; the quarantine has an extra column ``reasons``."""
    checked = frames.withColumn("reasons", violations(strict))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def fail_fast(frames: DataFrame, strict: bool = False) -> DataFrame:
    """The frames themselves; the query fails on the first invalid one."""
    found = violations(strict)
    message = F.concat(F.lit("invalid frame: "), F.to_json(found))
    checked = F.when(F.size(found) > 0, F.raise_error(message).cast("string")).otherwise(F.col("agent_id"))
    return frames.withColumn("agent_id", checked)
