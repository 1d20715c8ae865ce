"""Frame store: one row per agent and millisecond, newest first inside an agent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricloom.functions.keys import row_key_at, unix_ms
from metricloom.schemas import META_TTL_DAYS, META_VERSIONS, SYSTEM_TTL_DAYS

KEY = ["agent_id", "unix_ms"]
DAY_MS = 86_400_000


def store_rows(frames: DataFrame) -> DataFrame:
    """Frames as stored rows, before merging; empty labels are not stored."""
    ms = unix_ms(F.col("collected_at"))
    return frames.select(
        "agent_id",
        ms.alias("unix_ms"),
        row_key_at(F.col("agent_id"), ms).alias("row_key"),
        "fleet_id",
        "idempotency_key",
        F.when(F.size("labels") > 0, F.col("labels")).alias("labels"),
        "system",
        "network",
        "arrival_seq",
    )


def _latest(column: str, order: Column) -> Column:
    """Value of the last write that carried the column."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order)).alias(column)


def merge_rows(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per key: a later write replaces the groups it carries and leaves the others.

    The aggregate has a partial step before the exchange, so many writes to one key (all frames of an
    agent without a clock share the epoch) shrink to one row per task.
    """
    order_cols = [F.col(c) for c in (order or ["arrival_seq"])]
    last = order_cols[0] if len(order_cols) == 1 else F.struct(*order_cols)
    merged = rows.groupBy(*KEY).agg(
        _latest("fleet_id", last),
        _latest("idempotency_key", last),
        _latest("labels", last),
        _latest("system", last),
        _latest("network", last),
        *[F.max_by(F.col(c), last).alias(c) for c in (order or ["arrival_seq"])],
    )
    # The key text follows from the group and need not be shuffled.
    key = row_key_at(F.col("agent_id"), F.col("unix_ms"))
    return merged.select(*KEY, key.alias("row_key"), *[c for c in merged.columns if c not in KEY])


def upsert_frames(frames: DataFrame) -> DataFrame:
    """The frame store that results from writing ``frames`` in arrival order."""
    return merge_rows(store_rows(frames))


def scan_agent(store: DataFrame, agent_id: str, n: int) -> DataFrame:
    """Newest ``n`` rows whose key starts with ``agent#``: top-n without a full sort.

    The agent is filtered too, as only that reaches the files below a merge of several writes.
    """
    agent = (F.col("agent_id") == agent_id) | F.col("agent_id").startswith(f"{agent_id}#")
    return store.filter(agent & F.col("row_key").startswith(f"{agent_id}#")).orderBy("row_key").limit(n)


def apply_retention(
    rows: DataFrame,
    as_of: datetime,
    system_ttl_days: int = SYSTEM_TTL_DAYS,
    meta_ttl_days: int = META_TTL_DAYS,
    versions: int = META_VERSIONS,
    order: list[str] | None = None,
) -> DataFrame:
    """Rows left after garbage collection, one per kept version of a key (``version`` 1 is the newest).

    Ids and labels live ``meta_ttl_days`` in up to ``versions`` versions; system and network groups have a
    single version, shown on version 1, and live ``system_ttl_days``. ``order`` names the columns that tell later writes.
    """
    later = [F.col(c) for c in (order or ["arrival_seq"])]
    last = later[0] if len(later) == 1 else F.struct(*later)
    now = unix_ms(F.lit(as_of))
    live = rows.filter(F.col("unix_ms") >= now - F.lit(meta_ttl_days * DAY_MS))
    newest = Window.partitionBy(*KEY).orderBy(*[c.desc() for c in later])
    kept = live.withColumn("version", F.row_number().over(newest)).filter(F.col("version") <= versions)
    cells = live.groupBy(*KEY).agg(
        _latest("system", last), _latest("network", last)
    )
    fresh = (F.col("version") == 1) & (F.col("unix_ms") >= now - F.lit(system_ttl_days * DAY_MS))
    return (
        kept.drop("system", "network")
        .join(cells, KEY)
        .withColumn("system", F.when(fresh, F.col("system")))
        .withColumn("network", F.when(fresh, F.col("network")))
    )
