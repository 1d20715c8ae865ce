"""Recent summaries and fleet status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricloom.functions.keys import rfc3339_micros, row_key_ms, unix_ms
from metricloom.functions.metrics import guarded_mean, severity_name
from metricloom.schemas import DEFAULT_LAST_N, INFO, PLACEHOLDER_AGENT

# A hot agent's rows are first cut in so many parts, so that no task sorts them all.
_PARTS = 64


def _newest(store: DataFrame, most: Column) -> DataFrame:
    """Newest rows per agent with their rank ``rn``, up to ``most``: parts of an agent's rows first, then what is left."""
    part = Window.partitionBy("agent_id", F.pmod(F.xxhash64("row_key"), F.lit(_PARTS))).orderBy(F.desc("unix_ms"))
    rows = store.withColumn("_part_rn", F.row_number().over(part)).filter(F.col("_part_rn") <= most).drop("_part_rn")
    whole = Window.partitionBy("agent_id").orderBy(F.desc("unix_ms"))
    return rows.withColumn("rn", F.row_number().over(whole)).filter(F.col("rn") <= most)


def recent_n(store: DataFrame, n: int = DEFAULT_LAST_N) -> DataFrame:
    """Newest ``n`` rows per agent with their rank ``rn``; the store has one row per key."""
    return _newest(store, F.lit(n))


def _summary_input(store: DataFrame, *more: str) -> DataFrame:
    """CPU is null without system metrics; the time is 0 when the key cannot be parsed back."""
    return store.select(
        "agent_id",
        "unix_ms",
        "row_key",
        F.when(F.col("system").isNotNull(), F.coalesce("system.cpu_utilization_pct", F.lit(0.0))).alias("cpu"),
        F.coalesce(row_key_ms(F.col("row_key")), F.lit(0)).alias("seen_ms"),
        *more,
    )


def agent_recent_summary(store: DataFrame, n: int = DEFAULT_LAST_N) -> DataFrame:
    """Mean CPU over the newest ``n`` rows (rows without CPU count for ``n`` only) and the newest time."""
    return (
        recent_n(_summary_input(store), n)
        .groupBy("agent_id")
        .agg(guarded_mean(F.col("cpu")).alias("avg_cpu"), F.max("seen_ms").alias("last_seen_ms"))
    )


def _prefix_summaries(store: DataFrame, needs: DataFrame) -> DataFrame:
    """Summary of the newest k rows of the agents in ``needs`` (agent_id, most), for every k up to ``most`` or the agent's
    row count, which ``available`` tells up to there."""
    rows = _summary_input(store.join(needs, "agent_id"), "most")
    whole = Window.partitionBy("agent_id")
    upto = whole.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return _newest(rows, F.col("most")).select(
        "agent_id",
        F.col("rn").alias("k"),
        F.count(F.lit(1)).over(whole).alias("available"),
        F.coalesce(F.avg("cpu").over(upto), F.lit(0.0)).alias("recent_cpu"),
        F.max("seen_ms").over(upto).alias("recent_ms"),
    )


def clean_requests(requests: DataFrame) -> DataFrame:
    """Distinct requests; a missing or zero row count means the default."""
    n = F.coalesce("last_n_rows", F.lit(0))
    return requests.select(
        "fleet_id", F.when(n <= 0, F.lit(DEFAULT_LAST_N)).otherwise(n).cast("int").alias("last_n_rows")
    ).distinct()


def fleet_status_agents(
    state: DataFrame,
    store: DataFrame,
    requests: DataFrame,
    placeholder_as_of: datetime | None = None,
) -> DataFrame:
    """Status rows for a table of requests (fleet_id, last_n_rows), each with its own row count.

    Members first: only rows of agents in a requested fleet are read from the store, each agent's up to the largest count
    asked for it. The recent summary replaces both mean and time when it knows a time; otherwise both come from the state
    table. With ``placeholder_as_of`` an unknown fleet yields the stand-in agent seen at that time, otherwise nothing.
    """
    asked = clean_requests(requests)
    members = asked.join(state, "fleet_id")
    needs = members.groupBy("agent_id").agg(F.max("last_n_rows").alias("most"))
    recent = _prefix_summaries(store, needs)
    replaced = F.coalesce(F.col("recent_ms"), F.lit(0)) > 0
    agents = members.join(
        recent,
        (members["agent_id"] == recent["agent_id"]) & (recent["k"] == F.least(members["last_n_rows"], recent["available"])),
        "left",
    ).select(
        "fleet_id",
        "last_n_rows",
        members["agent_id"],
        F.when(replaced, F.col("recent_cpu")).otherwise(F.col("cpu")).alias("avg_cpu_utilization_pct"),
        F.when(replaced, F.col("recent_ms")).otherwise(F.col("last_seen_ms")).alias("last_seen_unix_ms"),
        "status",
    )
    if placeholder_as_of is None:
        return agents
    unknown = asked.join(state.select("fleet_id").distinct(), "fleet_id", "left_anti").select(
        "fleet_id",
        "last_n_rows",
        F.lit(PLACEHOLDER_AGENT).alias("agent_id"),
        F.lit(0.0).alias("avg_cpu_utilization_pct"),
        unix_ms(F.lit(placeholder_as_of)).alias("last_seen_unix_ms"),
        F.lit(INFO).alias("status"),
    )
    return agents.unionByName(unknown)


def fleet_agents(state: DataFrame, fleet_id: str) -> DataFrame:
    return state.filter(F.col("fleet_id") == fleet_id)


def fleet_status_summary(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Active agents per request; 0 for a fleet without any. Only the state table is needed."""
    counts = state.groupBy("fleet_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        clean_requests(requests)
        .join(counts, "fleet_id", "left")
        .select("fleet_id", "last_n_rows", F.coalesce("n", F.lit(0).cast("bigint")).alias("active_agent_count"))
    )


def fleet_status(agents: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """Nested response per request: ``fleet_id, last_n_rows, active_agent_count, agents, as_of``.

    ``agents`` are the rows of :func:`fleet_status_agents`, a stand-in included; they are sorted by id and counted. A
    response holds all agents of its fleet, as the interface asks; :func:`fleet_status_agents` is the form without nesting.
    """
    member = F.struct("agent_id", "avg_cpu_utilization_pct", "last_seen_unix_ms", "status")
    nested = agents.groupBy("fleet_id", "last_n_rows").agg(F.array_sort(F.collect_list(member)).alias("agents"))
    none = F.expr("cast(array() as array<struct<agent_id: string, avg_cpu_utilization_pct: double, last_seen_unix_ms: bigint, status: int>>)")
    found = clean_requests(requests).join(nested, ["fleet_id", "last_n_rows"], "left").withColumn("agents", F.coalesce("agents", none))
    return found.select(
        "fleet_id", "last_n_rows", F.size("agents").cast("bigint").alias("active_agent_count"), "agents", F.lit(as_of).alias("as_of")
    )


def fleet_status_json(status: DataFrame) -> DataFrame:
    """The response documents: lowerCamelCase names, 64-bit integers as strings, severity names."""
    agents = F.transform(
        "agents",
        lambda a: F.struct(
            a["agent_id"].alias("agentId"),
            a["avg_cpu_utilization_pct"].alias("avgCpuUtilizationPct"),
            a["last_seen_unix_ms"].cast("string").alias("lastSeenUnixMs"),
            severity_name(a["status"]).alias("status"),
        ),
    )
    document = F.struct(
        F.col("fleet_id").alias("fleetId"),
        F.col("active_agent_count").alias("activeAgentCount"),
        agents.alias("agents"),
        rfc3339_micros(F.col("as_of")).alias("asOf"),
    )
    return status.select("fleet_id", "last_n_rows", F.to_json(document).alias("document"))
