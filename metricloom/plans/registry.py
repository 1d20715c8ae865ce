"""Registered queries: each reads whole driver tables and returns flat columns a SQL engine can check."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.functions import keys, metrics, text
from metricloom.operators import alerts as al
from metricloom.operators import combine, dedup, detect as de, latency, logs, sketches, state as st, status, store, windows as wi
from metricloom.operators.validate import validate, violations
from metricloom.plans import tables as t
from metricloom.schemas import SINK_BUCKETS
from metricloom.session import fresh_dir, prepare
from metricloom.sources import agent_index, alert_feed, frames_json
from metricloom.sources.retention import collect_garbage_in_place
from metricloom.sources.store import write_dated, write_region_days
from metricloom.streaming import fleet_windows as sw, ingest, keyed_state as ks, late_windows, live_routing, redelivery, rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = datetime(2024, 1, 30, 20, 0)
RETENTION_AS_OF = datetime(2024, 2, 10)
RETENTION_META_DAYS = 35


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def nine(value: Column | str, name: str | None = None) -> Column:
    """Means and quotients are compared to nine digits."""
    column = F.round(value, 9)
    return column.alias(name) if name else column


# --- building blocks -------------------------------------------------------------------------------


def _accepted(spark, folder, labelled=False) -> DataFrame:
    """Detected frames that pass the de-duplication with forgetting."""
    return de.detect(dedup.dedup_batch_ttl(t.deliveries(spark, folder, labelled)))


def _marked(spark, folder) -> DataFrame:
    return de.detect(dedup.mark_duplicates_ttl(t.deliveries(spark, folder)))


def _alerts(spark, folder) -> DataFrame:
    return al.build_alerts(_accepted(spark, folder))


def _state(spark, folder) -> DataFrame:
    return st.latest_state(de.detect(dedup.dedup_batch(t.deliveries(spark, folder))))


def _store(spark, folder) -> DataFrame:
    return store.upsert_frames(dedup.dedup_batch_ttl(t.deliveries(spark, folder)))


def _flat(frames: DataFrame, *more: str) -> DataFrame:
    return frames.select(
        "idempotency_key",
        "agent_id",
        "fleet_id",
        "collected_at",
        nine("system.cpu_utilization_pct", "cpu"),
        F.col("system.memory_used_bytes").cast("double").alias("memory_used_bytes"),
        F.col("system.memory_total_bytes").cast("double").alias("memory_total_bytes"),
        nine("system.disk_io_read_mbps", "disk_io_read_mbps"),
        nine("system.disk_io_write_mbps", "disk_io_write_mbps"),
        nine("network.rx_mbps", "rx_mbps"),
        nine("network.tx_mbps", "tx_mbps"),
        F.col("network.tcp_retransmit_count").cast("double").alias("tcp_retransmit_count"),
        F.col("network.connection_count").cast("double").alias("connection_count"),
        text.labels_json(F.col("labels")).alias("labels"),
        *more,
    )


# --- decoding and validation -----------------------------------------------------------------------


def _broken_lines(frames: DataFrame, *kept: str) -> DataFrame:
    """Frames as JSON text in both spellings; every 97th is cut off, every 89th has a bad time, every 83rd an impossible one."""
    seq = F.col("arrival_seq")
    line = F.when(seq % 2 == 0, frames_json.frame_json("snake")).otherwise(frames_json.frame_json("camel"))
    lines = frames.select("arrival_seq", *kept, line.alias("_l"))
    broken = (
        F.when(seq % 97 == 0, F.expr("substring(_l, 1, length(_l) - 5)"))
        .when(seq % 89 == 0, F.regexp_replace("_l", '"(collected_at|collectedAt)":"', '"$1":"at '))
        .when(seq % 83 == 0, F.regexp_replace("_l", '"(collected_at|collectedAt)":"....-..', '"$1":"2024-13'))
        .otherwise(F.col("_l"))
    )
    return lines.select("arrival_seq", *kept, broken.alias("value"))


def _json_lines(spark, folder) -> DataFrame:
    return _broken_lines(t.frames(spark, folder, labelled=True))


@query
def frames_normalized(spark, folder):
    frames, _ = frames_json.decode_frames(_json_lines(spark, folder))
    return _flat(frames)


@query
def frames_undecodable(spark, folder):
    _, quarantine = frames_json.decode_frames(_json_lines(spark, folder))
    return quarantine.select("arrival_seq", F.explode("reasons").alias("r")).select("arrival_seq", "r.*")


def _defective(spark, folder) -> DataFrame:
    """Frames with missing ids, missing times and CPU values above 100."""
    seq = F.col("arrival_seq")
    raw_cpu = F.col("system").withField("cpu_utilization_pct", F.col("system.disk_io_read_mbps") * 4)
    return (
        t.frames(spark, folder)
        .withColumn("agent_id", F.when(seq % 31 != 0, F.col("agent_id")).otherwise(""))
        .withColumn("fleet_id", F.when(seq % 37 != 0, F.col("fleet_id")).otherwise(""))
        .withColumn("collected_at", F.when(seq % 41 != 0, F.col("collected_at")))
        .withColumn("system", raw_cpu)
    )


@query
def frames_valid(spark, folder):
    valid, _ = validate(_defective(spark, folder))
    return valid.select(
        "idempotency_key",
        "agent_id",
        "fleet_id",
        keys.unix_ms(F.col("collected_at")).alias("collected_ms"),
        F.col("system").isNotNull().alias("has_system"),
        nine(metrics.cpu_or_zero(), "cpu"),
    )


@query
def frames_quarantine(spark, folder):
    _, quarantine = validate(_defective(spark, folder), strict=True)
    reasons = F.transform("reasons", lambda r: F.concat(r["field"], F.lit(" "), r["description"]))
    return quarantine.select("idempotency_key", F.array_join(reasons, "; ").alias("reasons"))


@query
def field_violations(spark, folder):
    """How often each check fails."""
    found = _defective(spark, folder).select(F.explode(violations(strict=True)).alias("v"))
    return found.groupBy("v.field", "v.description").agg(F.count(F.lit(1)).alias("frames"))


# --- de-duplication --------------------------------------------------------------------------------


def _arrival(frames: DataFrame) -> DataFrame:
    return frames.select("idempotency_key", "agent_id", "fleet_id", "received_at", "arrival_seq")


@query
def frames_dedup(spark, folder):
    return _arrival(dedup.dedup_batch(t.deliveries(spark, folder)))


@query
def frames_dedup_ttl(spark, folder):
    return _arrival(dedup.dedup_batch_ttl(t.deliveries(spark, folder)))


@query
def duplicate_flags(spark, folder):
    return dedup.mark_duplicates(t.deliveries(spark, folder)).select("idempotency_key", "arrival_seq", "is_duplicate")


@query
def duplicate_flags_ttl(spark, folder):
    return dedup.mark_duplicates_ttl(t.deliveries(spark, folder)).select(
        "idempotency_key", "arrival_seq", "is_duplicate"
    )


# --- detection -------------------------------------------------------------------------------------


@query
def anomaly_flags(spark, folder):
    return de.detect(t.frames(spark, folder)).select(
        "idempotency_key", nine(metrics.memory_pct(), "memory_pct"), "is_anomaly", "severity", "severity_name"
    )


@query
def anomalies(spark, folder):
    return _flat(de.anomalies(de.detect(t.frames(spark, folder, labelled=True))))


@query
def policy_anomalies(spark, folder):
    found = de.policy_detect(t.frames(spark, folder), t.policies(spark, folder))
    return de.anomalies(found).select("idempotency_key", "agent_id", "fleet_id", nine(metrics.cpu_or_zero(), "cpu"))


@query
def custom_detector(spark, folder):
    """A detector made of a stricter threshold and a network rule."""
    busy = metrics.any_of(
        metrics.threshold_detector(cpu=95.0, memory=95.0),
        lambda: metrics.exceeds(F.col("network.rx_mbps"), F.lit(8.0)),
    )
    flagged = de.detect(t.frames(spark, folder), busy)
    return flagged.groupBy("fleet_id", "severity_name").agg(F.count(F.lit(1)).alias("frames"))


@query
def anomaly_messages(spark, folder):
    messages = de.anomaly_messages(_accepted(spark, folder, labelled=True))
    return messages.select(
        *[F.col("attributes")[n].alias(n) for n in ("agent_id", "fleet_id", "traceparent", "tracestate")],
        F.get_json_object("payload", "$.idempotency_key").alias("payload_key"),
        nine(F.get_json_object("payload", "$.system.cpu_utilization_pct").cast("double"), "payload_cpu"),
        F.get_json_object("payload", "$.labels.region").alias("payload_region"),
    )


@query
def labels_json(spark, folder):
    return t.frames(spark, folder, labelled=True).select(
        "idempotency_key", text.labels_json(F.col("labels")).alias("labels")
    )


@query
def trace_join(spark, folder):
    messages = de.anomaly_messages(_accepted(spark, folder))
    return de.trace_join(messages, t.frame_log(spark, folder)).select(
        F.get_json_object("payload", "$.idempotency_key").alias("idempotency_key"),
        "trace_id",
        text.span_id(F.col("attributes")["traceparent"]).alias("span_id"),
        "log_count",
        "first_logged_at",
        "last_logged_at",
        "error_count",
    )


@query
def trace_records(spark, folder):
    """Anomaly messages with the log records of their own span."""
    messages = de.anomaly_messages(_accepted(spark, folder))
    return de.trace_records(messages, t.frame_log(spark, folder)).select(
        F.get_json_object("payload", "$.idempotency_key").alias("idempotency_key"), "trace_id", "span_id", "logged_at", "code"
    )


# --- alerts ----------------------------------------------------------------------------------------


@query
def alerts(spark, folder):
    return _alerts(spark, folder)


@query
def alert_feed_decoded(spark, folder):
    """The alerts written as JSON and read back."""
    decoded, _ = alert_feed.decode_alerts(_alerts(spark, folder).select(alert_feed.alert_json().alias("value")))
    return decoded


@query
def alert_dead_letter(spark, folder):
    """Some alerts arrive cut off; they are set aside, delivered again, and set aside again."""
    line = alert_feed.alert_json()
    cut = F.col("alert_id") < "2"
    cut_off = F.when(cut, F.expr("substring(_l, 1, length(_l) - 2)")).otherwise(F.col("_l"))
    sent = _alerts(spark, folder).withColumn("_l", line).select(cut_off.alias("value"))
    _, first = alert_feed.decode_alerts(sent)
    _, second = alert_feed.decode_alerts(first)
    alert = F.regexp_extract("value", '"alertId":"([^"]*)"', 1).alias("alert_id")
    return first.unionByName(second).select(alert, "attempt")


@query
def alerts_routed(spark, folder):
    return al.route_alerts(_alerts(spark, folder), t.subscriptions(spark, folder)).select(
        "alert_id", "agent_id", "triggered_at", "subscribed_at"
    )


@query
def alerts_undelivered(spark, folder):
    return al.undelivered(_alerts(spark, folder), t.subscriptions(spark, folder)).select(
        "alert_id", "agent_id", "triggered_at"
    )


@query
def alerts_delivered(spark, folder):
    """At most 10 alerts per subscriber and minute fit its buffer."""
    routed = al.route_alerts(_alerts(spark, folder), t.subscriptions(spark, folder))
    return al.deliver(routed)[0].select("alert_id", "agent_id", "triggered_at")


@query
def alerts_overflow(spark, folder):
    routed = al.route_alerts(_alerts(spark, folder), t.subscriptions(spark, folder))
    return al.deliver(routed, cap=1, slot="1 day")[1].select("alert_id", "agent_id", "triggered_at")


@query
def alert_history(spark, folder):
    return al.alert_history(_alerts(spark, folder), "fleet-3", 25)


@query
def agent_alerts(spark, folder):
    return al.agent_alerts(_alerts(spark, folder), "agent-8")


@query
def acks(spark, folder):
    return al.acks(_marked(spark, folder))


@query
def stream_responses(spark, folder):
    return al.responses(_marked(spark, folder)).select(
        "arrival_seq",
        "ord",
        "kind",
        F.col("ack.idempotency_key").alias("ack_key"),
        F.col("ack.server_received_at").alias("ack_received_at"),
        F.col("alert.alert_id").alias("alert_id"),
        F.col("alert.agent_id").alias("alert_agent_id"),
        F.col("alert.severity_name").alias("alert_severity"),
    )


# --- store -----------------------------------------------------------------------------------------


@query
def row_keys(spark, folder):
    return t.frames(spark, folder).select(
        "idempotency_key", keys.row_key(F.col("agent_id"), F.col("collected_at")).alias("row_key")
    )


@query
def row_key_parse(spark, folder):
    key = keys.row_key(F.col("agent_id"), F.col("collected_at"))
    return t.frames(spark, folder).select("idempotency_key", keys.row_key_ms(key).alias("unix_ms"))


@query
def frames_upsert(spark, folder):
    """Two partial writes of every frame: system first, then network with the labels."""
    rows = t.frames(spark, folder, labelled=True)
    partial = (
        rows.withColumn("_p", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("system", F.when(F.col("_p") == 0, F.col("system")))
        .withColumn("network", F.when(F.col("_p") == 1, F.col("network")))
        .withColumn("labels", F.when(F.col("_p") == 1, F.col("labels")))
        .withColumn("idempotency_key", F.concat("idempotency_key", F.lit("/"), F.col("_p").cast("string")))
        .withColumn("arrival_seq", F.col("arrival_seq") * 2 + F.col("_p"))
    )
    merged = store.upsert_frames(partial).withColumn("collected_at", F.timestamp_millis("unix_ms"))
    return _flat(merged, "row_key")


@query
def agent_scan(spark, folder):
    return store.scan_agent(_store(spark, folder), "agent-8", 20).select(
        "row_key", "idempotency_key", nine("system.cpu_utilization_pct", "cpu")
    )


@query
def retention(spark, folder):
    rows = store.store_rows(t.deliveries(spark, folder))
    kept = store.apply_retention(rows, RETENTION_AS_OF, meta_ttl_days=RETENTION_META_DAYS, versions=2)
    return kept.select(
        "row_key",
        "version",
        "idempotency_key",
        "arrival_seq",
        nine("system.cpu_utilization_pct", "cpu"),
        F.col("network.connection_count").cast("double").alias("connection_count"),
    )


# --- state and status ------------------------------------------------------------------------------


@query
def recent_n(spark, folder):
    return status.recent_n(_store(spark, folder)).select("agent_id", "rn", "row_key", "idempotency_key")


@query
def agent_recent_summary(spark, folder):
    return status.agent_recent_summary(_store(spark, folder)).select(
        "agent_id", nine("avg_cpu", "avg_cpu"), "last_seen_ms"
    )


@query
def agent_state_latest(spark, folder):
    return _state(spark, folder)


@query
def agent_state_active(spark, folder):
    return st.active(_state(spark, folder), AS_OF)


@query
def fleet_status_agents(spark, folder):
    agents = status.fleet_status_agents(
        _state(spark, folder),
        _store(spark, folder),
        t.requests(spark, folder),
        placeholder_as_of=AS_OF,
    )
    return agents.withColumn("avg_cpu_utilization_pct", nine("avg_cpu_utilization_pct"))


@query
def fleet_status_large_n(spark, folder):
    """Three row counts per fleet, one beyond what any agent has."""
    fleets = t.requests(spark, folder).select("fleet_id")
    asked = fleets.withColumn("last_n_rows", F.explode(F.array(*[F.lit(n) for n in (3, 30, 5000)])))
    agents = status.fleet_status_agents(_state(spark, folder), _store(spark, folder), asked)
    return agents.withColumn("avg_cpu_utilization_pct", nine("avg_cpu_utilization_pct"))


@query
def fleet_lookup(spark, folder):
    return status.fleet_agents(_state(spark, folder), "fleet-5")


@query
def fleet_status_summary(spark, folder):
    return status.fleet_status_summary(_state(spark, folder), t.requests(spark, folder))


@query
def fleet_status_json(spark, folder):
    state, requests = _state(spark, folder), t.requests(spark, folder)
    agents = status.fleet_status_agents(state, _store(spark, folder), requests)
    rounded = agents.withColumn("avg_cpu_utilization_pct", nine("avg_cpu_utilization_pct"))
    return status.fleet_status_json(status.fleet_status(rounded, requests, AS_OF))


@query
def fleet_status_placeholder_json(spark, folder):
    """Documents of fleets without agents: the stand-in is listed and counted."""
    state, requests = _state(spark, folder), t.requests(spark, folder)
    agents = status.fleet_status_agents(state, _store(spark, folder), requests, placeholder_as_of=AS_OF)
    documents = status.fleet_status_json(status.fleet_status(agents, requests, AS_OF))
    return documents.join(state.select("fleet_id").distinct(), "fleet_id", "left_anti")


# --- windows ---------------------------------------------------------------------------------------


def _windows(found: DataFrame) -> DataFrame:
    return found.withColumn("avg_cpu_during_anomalies", nine("avg_cpu_during_anomalies"))


@query
def fleet_windows_60s(spark, folder):
    found = wi.fleet_windows(de.anomalies(de.detect(t.frames(spark, folder))))
    return wi.format_windows(_windows(found))


@query
def fleet_windows_1d(spark, folder):
    """Day windows with an extra aggregate of the caller's own."""
    found = wi.fleet_windows(
        de.anomalies(de.detect(t.frames(spark, folder))), "1 day", extra={"max_cpu": F.max("cpu")}
    )
    return _windows(found)


@query
def fleet_windows_no_time(spark, folder):
    """Every 41st frame has no clock: its anomaly counts at its arrival."""
    clock = F.when(F.col("arrival_seq") % 41 != 0, F.col("collected_at"))
    found = de.anomalies(de.detect(t.frames(spark, folder).withColumn("collected_at", clock)))
    return _windows(wi.fleet_windows(found))


@query
def fleet_region_day(spark, folder):
    found = wi.fleet_region_day(de.anomalies(de.detect(t.frames(spark, folder, labelled=True))))
    return _windows(found).withColumn("window_date", F.col("window_date").cast("string"))


# --- operations ------------------------------------------------------------------------------------


@query
def latency_histogram(spark, folder):
    found = latency.latency_histogram(t.rpc_log(spark, folder))
    bound = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return found.select("method", bound.alias("le"), "cumulative", "count", nine("sum", "sum"))


@query
def sink_histogram(spark, folder):
    """All durations in the buckets used for sink writes, not grouped."""
    found = latency.latency_histogram(t.rpc_log(spark, folder), SINK_BUCKETS, by=())
    bound = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return found.select(bound.alias("le"), "cumulative", "count", nine("sum", "sum"))


def _p99(spark, folder, window: str) -> DataFrame:
    histogram = latency.latency_histogram(t.rpc_log(spark, folder), window=window)
    return latency.quantile_from_buckets(histogram).select("window_start", nine("quantile", "p99"))


@query
def latency_p99(spark, folder):
    return _p99(spark, folder, "1 minute")


@query
def latency_p99_1d(spark, folder):
    return _p99(spark, folder, "1 day")


@query
def latency_quantiles(spark, folder):
    """Exact quantiles per method."""
    return latency.exact_quantiles(t.rpc_log(spark, folder), [0.5, 0.9, 0.95, 0.99], by=("method",)).select(
        "method", "probability", nine("value", "value")
    )


@query
def load_report(spark, folder):
    return latency.load_report(t.rpc_log(spark, folder)).withColumn("value", nine("value"))


@query
def inflight_streams(spark, folder):
    return latency.inflight(t.rpc_log(spark, folder))


@query
def golden_signals(spark, folder):
    return latency.golden_signals(t.rpc_log(spark, folder)).withColumn("error_rate", nine("error_rate"))


@query
def message_totals(spark, folder):
    return latency.message_totals(_marked(spark, folder))


@query
def log_summary(spark, folder):
    """Log lines of all responses plus status lines, then the scan."""
    lines = logs.render_log(al.responses(_marked(spark, folder)))
    counts = fleet_status_summary(spark, folder)
    statuses = counts.select(F.to_json(F.struct(F.col("active_agent_count").alias("activeAgentCount"))).alias("value"))
    found = logs.log_summary(lines.unionByName(statuses))
    return found.withColumn("active_agents", F.col("active_agents").cast("double"))


# --- streams ---------------------------------------------------------------------------------------


def _ingest(spark, folder) -> str:
    """Run the ingest job over the event file(s) until the input is used up; agents stay a day in the state."""
    out = fresh_dir(prepare(spark), "ingest")
    options = ingest.IngestOptions(state_ttl_ms=86_400_000)
    stream = t.stream_deliveries(spark, folder)
    ingest.run_ingest(stream, f"{out}/tables", f"{out}/checkpoint", options).awaitTermination()
    return f"{out}/tables"


@query
def stream_ingest_acks(spark, folder):
    return spark.read.parquet(f"{_ingest(spark, folder)}/acks").select("idempotency_key", "server_received_at")


@query
def stream_ingest_frames(spark, folder):
    return spark.read.parquet(f"{_ingest(spark, folder)}/frames").select(
        "row_key", "idempotency_key", nine("system.cpu_utilization_pct", "cpu"), F.col("event_date").cast("string")
    )


@query
def stream_state(spark, folder):
    return ingest.read_state(spark, _ingest(spark, folder))


@query
def stream_quarantine(spark, folder):
    """JSON payloads through the ingest job: what it cannot decode is set aside with the reasons."""
    out = fresh_dir(prepare(spark), "ingest")
    lines = _broken_lines(t.as_frames(t.stream_events(spark, folder)), "received_at")
    ingest.run_ingest(lines, f"{out}/tables", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/tables/quarantine")
    return rows.select("arrival_seq", F.explode("reasons").alias("r")).select("arrival_seq", "r.*")


@query
def stream_delivered(spark, folder):
    """Alerts that subscribers got, the events arriving in four micro-batches."""
    out = fresh_dir(prepare(spark), "ingest")
    options = ingest.IngestOptions(subscriptions=t.subscriptions(spark, folder))
    stream = t.redelivered(t.as_frames(t.staged_events(spark, folder, f"{out}/events")))
    ingest.run_ingest(stream, f"{out}/tables", f"{out}/checkpoint", options).awaitTermination()
    return ingest.read_delivered(spark, f"{out}/tables")[0].select("alert_id", "agent_id", "triggered_at")


@query
def stream_fleet_windows(spark, folder):
    """Ingest job, then the window job over its anomaly table."""
    tables = _ingest(spark, folder)
    out = fresh_dir(spark, "windows")
    messages = sw.stream_messages(spark, f"{tables}/anomalies")
    sw.run_windows(messages, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return _windows(sw.read_windows(spark, f"{out}/table").drop("window_date"))


@query
def stream_late_rows(spark, folder):
    """The window job by the agents' clocks over four micro-batches; every 50th event comes in the last, most of them late."""
    out = fresh_dir(prepare(spark), "windows")
    found = de.anomalies(de.detect(t.as_frames(t.staged_events(spark, folder, f"{out}/events", late=50))))
    sw.run_windows(found, f"{out}/table", f"{out}/checkpoint", time_col="collected_at").awaitTermination()
    return _windows(sw.read_windows(spark, f"{out}/table").drop("window_date"))


@query
def region_day_table(spark, folder):
    """Aggregates by date and region, written to the table partitioned by both, and read again."""
    path = fresh_dir(prepare(spark), "region-days")
    write_region_days(wi.fleet_region_day(de.anomalies(de.detect(t.frames(spark, folder, labelled=True)))), path)
    return _windows(spark.read.parquet(path)).withColumn("window_date", F.col("window_date").cast("string"))


@query
def stream_dedup(spark, folder):
    """Spark's own streaming de-duplication; one micro-batch, so keys are not forgotten within it."""
    out = fresh_dir(prepare(spark), "dedup")
    rows = dedup.dedup_stream(t.stream_deliveries(spark, folder)).select("idempotency_key", "agent_id", "collected_at")
    (
        rows.writeStream.format("parquet")
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/table")


def _run_to(rows: DataFrame, out: str) -> DataFrame:
    """Run a stream until its input is used up, and read what it wrote."""
    writer = rows.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/table")


@query
def stream_swept_keys(spark, folder):
    """Accepted arrivals by keyed state with timers, the deliveries coming in four micro-batches."""
    out = fresh_dir(prepare(spark), "swept")
    narrow = t.deliveries(spark, folder).select("idempotency_key", "received_at", "arrival_seq")
    with ks.rocksdb(spark):
        return _run_to(ks.accepted_stream(t.staged(narrow, f"{out}/in", "received_at")), out)


@query
def stream_agent_evictions(spark, folder):
    """Agent states given up at the sweep that finds them too old, the frames coming in four micro-batches."""
    out = fresh_dir(prepare(spark), "evictions")
    with ks.rocksdb(spark):
        stream = de.detect(t.staged(t.frames(spark, folder), f"{out}/in", "received_at"))
        rows = _run_to(ks.evictions_stream(stream), out)
    return rows.withColumn("cpu", nine("cpu"))


@query
def stream_live_routing(spark, folder):
    """Alerts routed while subscriptions come in between: alerts and subscriptions in four micro-batches each, by time."""
    out = fresh_dir(prepare(spark), "live")
    _alerts(spark, folder).write.parquet(f"{out}/all")
    live_routing.subscription_events(t.subscriptions(spark, folder)).write.parquet(f"{out}/all-events")
    alerts, events = spark.read.parquet(f"{out}/all"), spark.read.parquet(f"{out}/all-events")
    span = t.time_span(alerts, "triggered_at")
    alerts = t.staged(alerts, f"{out}/alerts", "triggered_at", span=span)
    events = t.staged(events, f"{out}/events", "at", span=span)
    with ks.rocksdb(spark):
        rows = _run_to(live_routing.route_live(alerts, events), out)
    return rows.select("alert_id", "agent_id", "triggered_at", "subscribed_at")


@query
def fleet_windows_top_label(spark, folder):
    """A combiner of the user's own per fleet and day: the event type that used the most CPU."""
    found = de.anomalies(de.detect(t.frames(spark, folder))).withColumn("kind", F.col("labels")["event_type"])
    rows = combine.combine_windows(found, combine.TopLabel("kind"), ["kind", "cpu"], "1 day")
    return rows.withColumn("cpu_share", nine("cpu_share"))


@query
def latency_sketches(spark, folder):
    """Quantiles per method and day out of stored sketches per minute, and whether they keep the stated rank error."""
    out = fresh_dir(prepare(spark), "sketches")
    log = t.rpc_log(spark, folder)
    sketches.write_sketches(sketches.sketch_log(log), out)
    days = sketches.merge_sketches(sketches.merge_sketches(sketches.read_sketches(spark, out), "1 hour"), "1 day")
    found = sketches.sketch_quantiles(days, [0.5, 0.95, 0.99])
    checked = sketches.rank_errors(found, log, "1 day")
    within = (F.col("rank_error") <= sketches.RANK_ERROR).alias("within")
    return checked.select("method", "window_start", "probability", "n", within)


@query
def stream_region_day_rollup(spark, folder):
    """The rollup by date and region, kept up batch by batch, the last of which comes twice."""
    out = fresh_dir(prepare(spark), "rollup")
    found = de.anomalies(de.detect(t.frames(spark, folder, labelled=True)))
    found = found.select("collected_at", "fleet_id", "labels", "system")
    stream = t.staged(found, f"{out}/in", "collected_at")
    rollup.run_rollup(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    first, last = t.time_span(found, "collected_at")
    again = found.filter((F.unix_micros("collected_at") - first) * 4 >= 3 * (last - first))
    rollup.merge_batch(again, 3, f"{out}/table")
    rows = rollup.read_rollup(spark, f"{out}/table").withColumn("window_date", F.col("window_date").cast("string"))
    return rows.withColumn("avg_cpu_during_anomalies", nine("avg_cpu_during_anomalies"))


@query
def retention_in_place(spark, folder):
    """Retention of a dated store in two runs a week apart; only the dates that changed between them are rewritten."""
    path = fresh_dir(prepare(spark), "store")
    write_dated(store.store_rows(t.deliveries(spark, folder)), path)
    limits = {"meta_ttl_days": RETENTION_META_DAYS, "versions": 2}
    collect_garbage_in_place(spark, path, RETENTION_AS_OF - timedelta(days=7), **limits)
    collect_garbage_in_place(spark, path, RETENTION_AS_OF, **limits)
    return spark.read.parquet(path).select(
        "row_key", "idempotency_key", "arrival_seq", nine("system.cpu_utilization_pct", "cpu"),
        F.col("network.connection_count").cast("double").alias("connection_count"),
    )


@query
def stream_redelivery(spark, folder):
    """Alerts some of which arrive cut off: a part can be repaired at the third attempt, the others are parked after three."""
    out = fresh_dir(prepare(spark), "redelivery")
    line = alert_feed.alert_json()
    sent = _alerts(spark, folder).withColumn("_l", line).withColumnRenamed("triggered_at", "received_at")
    cut = F.when(F.col("alert_id") < "2", F.expr("substring(_l, 1, length(_l) - 2)")).otherwise(F.col("_l"))
    sent.select(cut.alias("value"), "received_at").write.parquet(f"{out}/sent")
    sent = spark.read.parquet(f"{out}/sent")
    last = F.max("received_at").alias("received_at")
    ticks = sent.agg(last).select(F.lit(None).cast("string").alias("value"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"), "received_at")
    ticks = ticks.select("value", (F.col("received_at") + F.make_dt_interval(hours=F.col("n"))).alias("received_at"))
    later = [ticks.orderBy("received_at").offset(n).limit(1) for n in range(3)]
    stream = t.staged(sent, f"{out}/in", "received_at", 3, then=later)

    def repaired(tried):
        fixed = (F.col("attempt") >= 2) & (F.regexp_extract("value", '"alertId":"([^"]*)"', 1) < "1")
        tried = tried.withColumn("value", F.when(fixed, F.concat("value", F.lit('"}'))).otherwise(F.col("value")))
        return alert_feed.decode_alerts(tried)

    redelivery.run_redelivery(stream, f"{out}/tables", f"{out}/checkpoint", 3, "30 minutes", repaired).awaitTermination()
    delivered = spark.read.parquet(f"{out}/tables/alerts").select("alert_id", F.lit("delivered").alias("outcome"))
    parked = spark.read.parquet(f"{out}/tables/parked")
    parked = parked.filter("attempt = 3").select(F.regexp_extract("value", '"alertId":"([^"]*)"', 1).alias("alert_id"), F.lit("parked").alias("outcome"))
    return delivered.unionByName(parked)


@query
def agent_scan_indexed(spark, folder):
    """The same scan of one agent from the layout by agent, written in two generations."""
    path = fresh_dir(prepare(spark), "by-agent")
    rows, seq = dedup.dedup_batch_ttl(t.deliveries(spark, folder)), F.col("arrival_seq")
    agent_index.write_by_agent(store.upsert_frames(rows.filter(seq % 2 == 0)), path, 0)
    agent_index.write_by_agent(store.upsert_frames(rows.filter(seq % 2 == 1)), path, 1)
    found = agent_index.scan_by_agent(spark, path, "agent-8", 20)
    return found.select("row_key", "idempotency_key", nine("system.cpu_utilization_pct", "cpu"))


def _late_windows(spark, folder) -> str:
    """Run the window job that keeps late rows, by the agents' clocks; every 50th event comes in the last of four batches."""
    out = fresh_dir(prepare(spark), "late-windows")
    found = de.anomalies(de.detect(t.as_frames(t.staged_events(spark, folder, f"{out}/events", late=50))))
    late_windows.run_late_windows(found, f"{out}/tables", f"{out}/checkpoint", time_col="collected_at").awaitTermination()
    return f"{out}/tables"


@query
def stream_windows_kept(spark, folder):
    """Windows of the job that keeps late rows."""
    return _windows(spark.read.parquet(f"{_late_windows(spark, folder)}/windows").drop("batch_id"))


@query
def stream_late_table(spark, folder):
    """What came after its window was closed."""
    rows = spark.read.parquet(f"{_late_windows(spark, folder)}/late")
    return rows.select("fleet_id", "agent_id", "event_time", nine("cpu", "cpu"), "window_start")
