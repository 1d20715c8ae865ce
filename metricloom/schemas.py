"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Leaf fields of the two metric groups of a frame, with their Spark types.
SYSTEM_FIELDS = {
    "cpu_utilization_pct": "double",
    "memory_used_bytes": "uint64",
    "memory_total_bytes": "uint64",
    "disk_io_read_mbps": "double",
    "disk_io_write_mbps": "double",
}
NETWORK_FIELDS = {
    "rx_mbps": "double",
    "tx_mbps": "double",
    "tcp_retransmit_count": "uint64",
    "connection_count": "uint64",
}

# Severity codes and names.
SEVERITY_NAMES = {
    0: "SEVERITY_UNSPECIFIED",
    1: "SEVERITY_INFO",
    2: "SEVERITY_WARNING",
    3: "SEVERITY_CRITICAL",
}
INFO, CRITICAL = 1, 3

# Fixed value: the text of every alert.
ALERT_MESSAGE = "Anomaly detected: metric threshold exceeded"

# Fixed value: name of the stand-in agent reported for a fleet without agents.
PLACEHOLDER_AGENT = "no-active-agents"

# Upper bounds in seconds of the duration histograms.
RPC_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
SINK_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# Defaults of thresholds, time limits and sizes.
DEFAULT_CPU_PCT = 90.0
DEFAULT_MEMORY_PCT = 90.0
DEFAULT_LAST_N = 10
DEDUP_TTL = "10 minutes"
DEDUP_SWEEP = "5 minutes"
STATE_TTL_MS = 3_600_000
STATE_SWEEP = "10 minutes"
WINDOW = "60 seconds"
ALERT_BUFFER = 10
SYSTEM_TTL_DAYS = 30
META_TTL_DAYS = 90
META_VERSIONS = 3


def _group(fields: dict[str, str], uint64: str) -> str:
    return ", ".join(f"{n}: {uint64 if t == 'uint64' else t}" for n, t in fields.items())


def frame_schema(uint64: str = "decimal(20,0)") -> T.StructType:
    """Frame columns. Unsigned 64-bit counters need ``decimal(20,0)``; ``bigint`` is the compact form."""
    return T.StructType.fromDDL(
        "agent_id string, fleet_id string, collected_at timestamp, idempotency_key string, "
        f"system struct<{_group(SYSTEM_FIELDS, uint64)}>, "
        f"network struct<{_group(NETWORK_FIELDS, uint64)}>, "
        "labels map<string,string>, received_at timestamp, arrival_seq bigint, traceparent string"
    )


# Field names of the messages and tables.
REASONS = "array<struct<field: string, description: string>>"
ALERTS = (
    "alert_id string, agent_id string, fleet_id string, severity int, severity_name string, "
    "message string, triggered_at timestamp"
)
ANOMALY_MESSAGES = "payload string, attributes map<string,string>, published_at timestamp"
AGENT_STATE = "fleet_id string, agent_id string, cpu double, last_seen_ms bigint, status int"
SEEN_KEYS = "idempotency_key string, bucket bigint"
FLEET_WINDOWS = (
    "fleet_id string, window_start timestamp, window_end timestamp, anomaly_count bigint, "
    "avg_cpu_during_anomalies double"
)
POLICIES = (
    "policy_id string, fleet_id string, cpu_threshold_pct double, memory_threshold_pct double, enabled boolean"
)
REQUESTS = "fleet_id string, last_n_rows int"
