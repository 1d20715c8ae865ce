"""Time in milliseconds and the newest-first row key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_LONG = 2**63 - 1
MIN_LONG = -(2**63)


def unix_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded down; a missing time counts as the epoch."""
    return F.coalesce(F.unix_millis(ts), F.lit(0).cast("bigint"))


def _inverted(ms: Column) -> Column:
    # 64-bit wrap-around for times before the epoch, which would overflow under ANSI arithmetic.
    return F.when(ms >= 0, F.lit(MAX_LONG) - F.greatest(ms, F.lit(0))).otherwise(
        F.lit(MIN_LONG) - (F.least(ms, F.lit(-1)) + 1)
    )


def row_key_at(agent_id: Column, ms: Column) -> Column:
    """``agent#inverted-ms``: ascending text order within an agent is newest first."""
    return F.concat(agent_id, F.lit("#"), _inverted(ms).cast("string"))


def row_key(agent_id: Column, ts: Column) -> Column:
    return row_key_at(agent_id, unix_ms(ts))


def row_key_ms(key: Column) -> Column:
    """Time of a row key; null unless it is exactly two parts with an integer second part."""
    parts = F.split(key, "#")
    number = F.when(
        (F.size(parts) == 2) & F.coalesce(F.get(parts, F.lit(1)).rlike("^[+-]?[0-9]+$"), F.lit(False)),
        F.get(parts, F.lit(1)).try_cast("bigint"),
    )
    return F.try_subtract(F.lit(MAX_LONG), number)


def _utc_text(seconds: Column) -> Column:
    """Date and time of whole seconds since the epoch, as UTC whatever the session's time zone."""
    day = F.lit(86_400).cast("bigint")
    rest = F.pmod(seconds, day)
    parts = [F.call_function("div", rest, F.lit(3600)), F.call_function("div", F.pmod(rest, F.lit(3600)), F.lit(60)), F.pmod(rest, F.lit(60))]
    clock = F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", seconds - rest, day).cast("int"))
    return F.when(seconds.isNotNull(), F.concat(date.cast("string"), F.lit("T"), clock))


def rfc3339(ts: Column) -> Column:
    """UTC text of a timestamp, seconds precision."""
    micros = F.unix_micros(ts)
    return F.concat(_utc_text(F.call_function("div", micros - F.pmod(micros, F.lit(10**6)), F.lit(10**6))), F.lit("Z"))


def rfc3339_micros(ts: Column) -> Column:
    """The same with six decimals."""
    micros = F.unix_micros(ts)
    rest = F.pmod(micros, F.lit(10**6))
    decimals = F.lpad(rest.cast("string"), 6, "0")
    return F.concat(_utc_text(F.call_function("div", micros - rest, F.lit(10**6))), F.lit("."), decimals, F.lit("Z"))


def utc_date(ts: Column) -> Column:
    """Date of a timestamp in UTC."""
    micros, day = F.unix_micros(ts), F.lit(86_400 * 10**6).cast("bigint")
    return F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", micros - F.pmod(micros, day), day).cast("int"))


def interval_micros(text: str) -> int:
    """Microseconds of a short interval such as ``'10 minutes'``."""
    units = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    number, unit = text.split()
    return int(number) * units[unit.rstrip("s")]


def time_bucket(ts: Column, width_micros: int) -> Column:
    """Number of the fixed-width time slot that holds ``ts`` (slots start at the epoch)."""
    micros = F.unix_micros(ts)
    width = F.lit(width_micros).cast("bigint")
    return F.call_function("div", micros - F.pmod(micros, width), width)
