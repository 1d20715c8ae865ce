"""Metric access with the defaults of the message format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from metricloom.schemas import CRITICAL, DEFAULT_CPU_PCT, DEFAULT_MEMORY_PCT, INFO, SEVERITY_NAMES

Detector = Callable[[], Column]


def cpu_or_zero() -> Column:
    """CPU percentage; 0.0 when the frame carries no system metrics."""
    return F.coalesce(F.col("system.cpu_utilization_pct"), F.lit(0.0))


def memory_pct() -> Column:
    """Used share of memory in percent; null when the total is 0 or unknown."""
    used = F.coalesce(F.col("system.memory_used_bytes").cast("double"), F.lit(0.0))
    return F.try_divide(used, F.col("system.memory_total_bytes").cast("double")) * 100


def exceeds(value: Column, limit: Column) -> Column:
    """Strictly greater, false for null and NaN on either side (Spark orders NaN above all numbers).

    ``nanvl`` instead of ``isnan(x) and x > y``: the operands are expressions and are evaluated once.
    """
    missing = F.lit(None).cast("double")
    return F.coalesce(F.nanvl(value, missing) > F.nanvl(limit, missing), F.lit(False))


def _limit(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def threshold_detector(
    cpu: float | Column = DEFAULT_CPU_PCT, memory: float | Column = DEFAULT_MEMORY_PCT
) -> Detector:
    """Detector that fires when CPU or memory is strictly above its limit; limits may be columns."""

    def flag() -> Column:
        return F.col("system").isNotNull() & (
            exceeds(cpu_or_zero(), _limit(cpu)) | exceeds(memory_pct(), _limit(memory))
        )

    return flag


def any_of(*detectors: Detector) -> Detector:
    """Fires when one of the detectors does."""

    def flag() -> Column:
        result = F.lit(False)
        for detector in detectors:
            result = result | F.coalesce(detector(), F.lit(False))
        return result

    return flag


def severity_code(is_anomaly: Column) -> Column:
    return F.when(is_anomaly, F.lit(CRITICAL)).otherwise(F.lit(INFO))


def severity_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SEVERITY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit(SEVERITY_NAMES[0]))


def severity_from_name(name: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for code, text in SEVERITY_NAMES.items() for x in (text, code)])
    return F.try_element_at(codes, name)


def guarded_mean(value: Column) -> Column:
    """Mean of the present values, 0.0 when there is none."""
    return F.coalesce(F.avg(value), F.lit(0.0))
