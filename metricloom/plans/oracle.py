"""SQL twins of the registered queries, written against the driver tables."""

from __future__ import annotations

# Common table expressions, each using only the ones before it.
CTES: dict[str, str] = {
    "frames": """
        SELECT 'agent-' || user_id AS agent_id, 'fleet-' || (user_id % 8) AS fleet_id, ts AS collected_at,
               'evt-' || event_id AS idempotency_key, event_type, r_name AS region,
               event_type <> 'signup' AS has_system, event_type <> 'view' AS has_network,
               CASE WHEN event_type <> 'signup' THEN least(value, 100.0::DOUBLE) END AS cpu,
               CASE WHEN event_type <> 'signup' THEN value END AS raw_cpu,
               CASE WHEN event_type <> 'signup' THEN k * 83 END AS memory_used_bytes,
               CASE WHEN event_type <> 'signup' THEN CASE WHEN event_id % 10 = 0 THEN 0 ELSE 8192 END END::BIGINT
                   AS memory_total_bytes,
               CASE WHEN event_type <> 'signup' THEN value / 4 END AS disk_io_read_mbps,
               CASE WHEN event_type <> 'signup' THEN value / 8 END AS disk_io_write_mbps,
               CASE WHEN event_type <> 'view' THEN value / 10 END AS rx_mbps,
               CASE WHEN event_type <> 'view' THEN value / 20 END AS tx_mbps,
               CASE WHEN event_type <> 'view' THEN k % 3 END AS tcp_retransmit_count,
               CASE WHEN event_type <> 'view' THEN k END AS connection_count,
               '{"event_type":"' || event_type || '","region":"' || r_name || '"}' AS labels,
               ts + INTERVAL 1 SECOND AS received_at, event_id AS arrival_seq,
               epoch_us(ts) // 1000 AS unix_ms,
               'agent-' || user_id || '#' || (9223372036854775807 - epoch_us(ts) // 1000) AS row_key,
               '00-' || md5(user_id || '/' || strftime(ts, '%Y-%m-%d')) || '-'
                   || substr(md5(event_id::VARCHAR), 1, 16) || '-01' AS traceparent
        FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e
        LEFT JOIN customer ON c_custkey = user_id
        LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "flagged": """
        SELECT *, CASE WHEN memory_total_bytes > 0
                       THEN memory_used_bytes::DOUBLE / memory_total_bytes::DOUBLE * 100 END AS memory_pct,
               coalesce(cpu, 0.0) AS cpu0,
               coalesce(has_system AND (cpu > 90 OR (memory_total_bytes > 0 AND
                   memory_used_bytes::DOUBLE / memory_total_bytes::DOUBLE * 100 > 90)), false) AS is_anomaly
        FROM frames""",
    "deliveries": """
        SELECT * FROM flagged
        UNION ALL
        SELECT * REPLACE (collected_at + INTERVAL 60 SECOND AS received_at, arrival_seq + 1000000000 AS arrival_seq)
        FROM flagged WHERE arrival_seq % 20 = 0
        UNION ALL
        SELECT * REPLACE (collected_at + INTERVAL 20 MINUTE AS received_at, arrival_seq + 2000000000 AS arrival_seq)
        FROM flagged WHERE arrival_seq % 50 = 0""",
    "slots": """
        SELECT idempotency_key, epoch_us(received_at) // 300000000 AS bucket, min(arrival_seq) AS arrival_seq
        FROM deliveries GROUP BY ALL""",
    "hops": """
        SELECT a.idempotency_key, a.bucket, min(b.bucket) AS following
        FROM slots a JOIN slots b ON a.idempotency_key = b.idempotency_key AND b.bucket > a.bucket + 2
        GROUP BY ALL""",
    "chain": """
        SELECT idempotency_key, min(bucket) AS bucket FROM slots GROUP BY ALL
        UNION ALL
        SELECT c.idempotency_key, h.following
        FROM chain c JOIN hops h ON c.idempotency_key = h.idempotency_key AND c.bucket = h.bucket""",
    "accepted": "SELECT arrival_seq FROM slots JOIN chain USING (idempotency_key, bucket)",
    "marked": "SELECT *, arrival_seq NOT IN (SELECT arrival_seq FROM accepted) AS is_duplicate FROM deliveries",
    "fresh": "SELECT * FROM marked WHERE NOT is_duplicate",
    "alert_rows": """
        SELECT substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-'
                   || substr(d, 21, 12) AS alert_id,
               agent_id, fleet_id, 3 AS severity, 'SEVERITY_CRITICAL' AS severity_name,
               'Anomaly detected: metric threshold exceeded' AS message, received_at AS triggered_at, arrival_seq
        FROM (SELECT *, sha256(idempotency_key || '|' || epoch_us(received_at)) AS d FROM fresh WHERE is_anomaly)""",
    "subs": """
        SELECT *, lead(subscribed_at) OVER (PARTITION BY agent_id ORDER BY subscribed_at) AS replaced_at
        FROM (SELECT DISTINCT 'agent-' || user_id AS agent_id,
                     unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15']) AS subscribed_at
              FROM events WHERE user_id % 3 = 0)""",
    "routed": """
        SELECT a.*, s.subscribed_at FROM alert_rows a JOIN subs s ON a.agent_id = s.agent_id
           AND a.triggered_at >= s.subscribed_at
           AND (s.replaced_at IS NULL OR a.triggered_at < s.replaced_at)""",
    "store": """
        SELECT agent_id, unix_ms, row_key, arg_max(idempotency_key, arrival_seq) AS idempotency_key,
               arg_max(cpu, arrival_seq) FILTER (WHERE has_system) AS cpu,
               row_number() OVER (PARTITION BY agent_id ORDER BY unix_ms DESC) AS rn
        FROM fresh GROUP BY agent_id, unix_ms, row_key""",
    "state": """
        SELECT fleet_id, agent_id, arg_max(cpu0, arrival_seq) AS cpu, arg_max(unix_ms, arrival_seq) AS last_seen_ms,
               arg_max(CASE WHEN is_anomaly THEN 3 ELSE 1 END, arrival_seq) AS status
        FROM flagged GROUP BY ALL""",
    "requests": """
        SELECT DISTINCT 'fleet-' || (user_id % 8) AS fleet_id,
               CASE WHEN user_id % 8 = 0 THEN 10 ELSE user_id % 8 + 3 END::INT AS last_n_rows FROM events
        UNION ALL SELECT 'fleet-unknown', 5""",
    "agents": """
        SELECT r.fleet_id, r.last_n_rows, s.agent_id, s.status,
               coalesce(avg(t.cpu), 0.0) AS avg_cpu_utilization_pct, max(t.unix_ms) AS last_seen_unix_ms
        FROM requests r JOIN state s USING (fleet_id)
        JOIN store t ON t.agent_id = s.agent_id AND t.rn <= r.last_n_rows
        GROUP BY ALL""",
    "documents_json": """
        SELECT r.fleet_id, r.last_n_rows,
               '{"fleetId":"' || r.fleet_id || '","activeAgentCount":' || count(a.agent_id) || ',"agents":['
               || coalesce(string_agg('{"agentId":"' || a.agent_id || '","avgCpuUtilizationPct":'
                      || round(a.avg_cpu_utilization_pct, 9) || ',"lastSeenUnixMs":"' || a.last_seen_unix_ms
                      || '","status":"' || CASE a.status WHEN 3 THEN 'SEVERITY_CRITICAL' ELSE 'SEVERITY_INFO' END
                      || '"}', ',' ORDER BY a.agent_id), '')
               || '],"asOf":"2024-01-30T20:00:00.000000Z"}' AS document
        FROM requests r LEFT JOIN agents a ON a.fleet_id = r.fleet_id AND a.last_n_rows = r.last_n_rows
        GROUP BY r.fleet_id, r.last_n_rows""",
    "late": """
        SELECT *, CASE WHEN arrival_seq % 50 = 0 THEN 3
                  ELSE least(floor((epoch_us(collected_at) - lo) * 4 / greatest(1, hi - lo)), 3) END AS part
        FROM flagged, (SELECT min(epoch_us(collected_at)) AS lo, max(epoch_us(collected_at)) AS hi FROM frames)
        WHERE is_anomaly""",
    # Rows are measured against the watermark that stood when the batch before began.
    "late_mark": """
        SELECT max(collected_at) FILTER (WHERE part < 2) - INTERVAL 10 MINUTE AS low,
               max(collected_at) - INTERVAL 10 MINUTE AS high FROM late""",
    "on_time": """
        SELECT late.* FROM late
        WHERE part < 3 OR time_bucket(INTERVAL '1 minute', collected_at) + INTERVAL 1 MINUTE
                          > (SELECT max(collected_at) FILTER (WHERE part < 3 AND is_anomaly) - INTERVAL 10 MINUTE FROM late)""",
    "kept_late": """
        SELECT late.* FROM late, late_mark
        WHERE part < 3 OR time_bucket(INTERVAL '1 minute', collected_at) + INTERVAL 1 MINUTE > low""",
    "rpc": """
        SELECT event_type AS method, ts AS started_at,
               ts + to_microseconds(round(value * 1000)::BIGINT) AS ended_at, value / 1000 AS duration_s,
               CASE WHEN event_type = 'error' THEN 'INTERNAL' ELSE 'OK' END AS code
        FROM events""",
    "bounds": """
        SELECT unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 'inf'::DOUBLE]::DOUBLE[]) AS le""",
}

FLAT = """
    idempotency_key, agent_id, fleet_id, collected_at, round(cpu, 9) AS cpu,
    memory_used_bytes::DOUBLE AS memory_used_bytes, memory_total_bytes::DOUBLE AS memory_total_bytes,
    round(disk_io_read_mbps, 9) AS disk_io_read_mbps, round(disk_io_write_mbps, 9) AS disk_io_write_mbps,
    round(rx_mbps, 9) AS rx_mbps, round(tx_mbps, 9) AS tx_mbps,
    tcp_retransmit_count::DOUBLE AS tcp_retransmit_count, connection_count::DOUBLE AS connection_count, labels"""

DEFECTIVE = """
    SELECT * REPLACE (CASE WHEN arrival_seq % 31 <> 0 THEN agent_id ELSE '' END AS agent_id,
                      CASE WHEN arrival_seq % 37 <> 0 THEN fleet_id ELSE '' END AS fleet_id,
                      CASE WHEN arrival_seq % 41 <> 0 THEN collected_at END AS collected_at)
    FROM frames"""

VIOLATIONS = f"""
    SELECT arrival_seq, idempotency_key, 1 AS n, 'agent_id' AS field, 'is required' AS description
    FROM ({DEFECTIVE}) WHERE agent_id = ''
    UNION ALL SELECT arrival_seq, idempotency_key, 2, 'fleet_id', 'is required' FROM ({DEFECTIVE}) WHERE fleet_id = ''
    UNION ALL SELECT arrival_seq, idempotency_key, 3, 'system.cpu_utilization_pct', 'must be between 0 and 100'
    FROM ({DEFECTIVE}) WHERE raw_cpu < 0 OR raw_cpu > 100
    UNION ALL SELECT arrival_seq, idempotency_key, 4, 'collected_at', 'is required'
    FROM ({DEFECTIVE}) WHERE collected_at IS NULL"""

ALERT = "alert_id, agent_id, fleet_id, severity, severity_name, message, triggered_at"


def _windows(rows: str, width: str, extra: str = "", at: str = "collected_at") -> str:
    start = "time_bucket(INTERVAL '1 minute', {0})" if width == "1 minute" else "date_trunc('day', {0})"
    return f"""
        SELECT fleet_id, {start.format(at)} AS window_start,
               {start.format(at)} + INTERVAL {width} AS window_end, count(*) AS anomaly_count,
               round(avg(cpu0), 9) AS avg_cpu_during_anomalies{extra}
        FROM {rows} WHERE is_anomaly GROUP BY ALL"""


def _p99(unit: str) -> str:
    return f"""
        SELECT window_start, round(CASE WHEN isinf(le) THEN lower
                   ELSE lower + (le - lower) * (rank - below) / (cumulative - below) END, 9) AS p99
        FROM (SELECT *, 0.99 * max(cumulative) OVER (PARTITION BY window_start) AS rank,
                     coalesce(lag(le) OVER (PARTITION BY window_start ORDER BY le), 0) AS lower,
                     coalesce(lag(cumulative) OVER (PARTITION BY window_start ORDER BY le), 0) AS below
              FROM (SELECT date_trunc('{unit}', ended_at) AS window_start, le,
                           count(*) FILTER (WHERE duration_s <= le) AS cumulative
                    FROM rpc, bounds GROUP BY ALL))
        WHERE rank <= cumulative AND rank > below"""


BODIES: dict[str, str] = {
    "frames_normalized": f"SELECT {FLAT} FROM frames WHERE arrival_seq % 97 <> 0 AND arrival_seq % 89 <> 0 AND arrival_seq % 83 <> 0",
    "frames_undecodable": """
        SELECT arrival_seq, CASE WHEN arrival_seq % 97 = 0 THEN '' ELSE 'collected_at' END AS field,
               CASE WHEN arrival_seq % 97 = 0 THEN 'not a JSON frame' ELSE 'not an RFC 3339 time' END AS description
        FROM frames WHERE arrival_seq % 97 = 0 OR arrival_seq % 89 = 0 OR arrival_seq % 83 = 0""",
    "frames_valid": f"""
        SELECT idempotency_key, agent_id, fleet_id,
               CASE WHEN collected_at IS NULL THEN 0 ELSE unix_ms END AS collected_ms, has_system,
               round(coalesce(raw_cpu, 0.0), 9) AS cpu
        FROM ({DEFECTIVE}) WHERE agent_id <> '' AND fleet_id <> ''""",
    "frames_quarantine": f"""
        SELECT idempotency_key, string_agg(field || ' ' || description, '; ' ORDER BY n) AS reasons
        FROM ({VIOLATIONS}) GROUP BY ALL""",
    "field_violations": f"SELECT field, description, count(*) AS frames FROM ({VIOLATIONS}) GROUP BY ALL",
    "frames_dedup": """
        SELECT idempotency_key, agent_id, fleet_id, received_at, arrival_seq FROM deliveries
        QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY arrival_seq) = 1""",
    "frames_dedup_ttl": "SELECT idempotency_key, agent_id, fleet_id, received_at, arrival_seq FROM fresh",
    "duplicate_flags": """
        SELECT idempotency_key, arrival_seq,
               row_number() OVER (PARTITION BY idempotency_key ORDER BY arrival_seq) > 1 AS is_duplicate
        FROM deliveries""",
    "duplicate_flags_ttl": "SELECT idempotency_key, arrival_seq, is_duplicate FROM marked",
    "anomaly_flags": """
        SELECT idempotency_key, round(memory_pct, 9) AS memory_pct, is_anomaly,
               CASE WHEN is_anomaly THEN 3 ELSE 1 END::INT AS severity,
               CASE WHEN is_anomaly THEN 'SEVERITY_CRITICAL' ELSE 'SEVERITY_INFO' END AS severity_name
        FROM flagged""",
    "anomalies": f"SELECT {FLAT} FROM flagged WHERE is_anomaly",
    "policy_anomalies": """
        SELECT idempotency_key, agent_id, fleet_id, round(cpu0, 9) AS cpu
        FROM (SELECT *, CASE WHEN substr(fleet_id, 7)::INT % 2 = 0 THEN 60 ELSE 90 END AS cpu_limit,
                     CASE WHEN substr(fleet_id, 7)::INT % 2 = 0 THEN 80 ELSE 90 END AS memory_limit FROM flagged)
        WHERE has_system AND (cpu > cpu_limit OR coalesce(memory_pct > memory_limit, false))""",
    "custom_detector": """
        SELECT fleet_id, CASE WHEN coalesce(has_system AND (cpu > 95 OR memory_pct > 95), false)
                                OR coalesce(rx_mbps > 8, false)
                              THEN 'SEVERITY_CRITICAL' ELSE 'SEVERITY_INFO' END AS severity_name, count(*) AS frames
        FROM flagged GROUP BY ALL""",
    "anomaly_messages": """
        SELECT agent_id, fleet_id, traceparent, '' AS tracestate, idempotency_key AS payload_key,
               round(cpu, 9) AS payload_cpu, region AS payload_region
        FROM fresh WHERE is_anomaly""",
    "labels_json": "SELECT idempotency_key, labels FROM frames",
    "trace_join": """
        SELECT idempotency_key, trace_id, split_part(traceparent, '-', 3) AS span_id, log_count, first_logged_at,
               last_logged_at, error_count
        FROM (SELECT *, split_part(traceparent, '-', 2) AS trace_id FROM fresh WHERE is_anomaly)
        JOIN (SELECT split_part(traceparent, '-', 2) AS trace_id, count(*) AS log_count,
                     min(received_at) AS first_logged_at, max(received_at) AS last_logged_at,
                     count(*) FILTER (WHERE event_type = 'error') AS error_count
              FROM frames GROUP BY ALL) USING (trace_id)""",
    "trace_records": """
        SELECT f.idempotency_key, split_part(f.traceparent, '-', 2) AS trace_id, split_part(f.traceparent, '-', 3) AS span_id,
               l.received_at AS logged_at, CASE WHEN l.event_type = 'error' THEN 'INTERNAL' ELSE 'OK' END AS code
        FROM fresh f JOIN frames l USING (traceparent) WHERE f.is_anomaly""",
    "alerts": f"SELECT {ALERT} FROM alert_rows",
    "alert_feed_decoded": f"SELECT {ALERT} FROM alert_rows",
    "alerts_routed": "SELECT alert_id, agent_id, triggered_at, subscribed_at FROM routed",
    "alert_dead_letter": "SELECT alert_id, unnest([1, 2])::INT AS attempt FROM alert_rows WHERE alert_id < '2'",
    "alerts_undelivered": """
        SELECT alert_id, agent_id, triggered_at FROM alert_rows
        WHERE alert_id NOT IN (SELECT alert_id FROM routed)""",
    "alerts_delivered": """
        SELECT alert_id, agent_id, triggered_at FROM routed
        QUALIFY row_number() OVER (PARTITION BY agent_id, date_trunc('minute', triggered_at)
                                   ORDER BY triggered_at, alert_id) <= 10""",
    "alerts_overflow": """
        SELECT alert_id, agent_id, triggered_at FROM routed
        QUALIFY row_number() OVER (PARTITION BY agent_id, date_trunc('day', triggered_at)
                                   ORDER BY triggered_at, alert_id) > 1""",
    "alert_history": f"""
        SELECT {ALERT} FROM alert_rows WHERE fleet_id = 'fleet-3' ORDER BY triggered_at DESC, alert_id LIMIT 25""",
    "agent_alerts": f"SELECT {ALERT} FROM alert_rows WHERE agent_id = 'agent-8'",
    "acks": """
        SELECT idempotency_key, CASE WHEN NOT is_duplicate THEN received_at END AS server_received_at FROM marked""",
    "stream_responses": """
        SELECT arrival_seq, 1 AS ord, 'ack' AS kind, idempotency_key AS ack_key,
               CASE WHEN NOT is_duplicate THEN received_at END AS ack_received_at, NULL::VARCHAR AS alert_id,
               NULL::VARCHAR AS alert_agent_id, NULL::VARCHAR AS alert_severity
        FROM marked
        UNION ALL
        SELECT arrival_seq, 0, 'alert', NULL, NULL, alert_id, agent_id, severity_name FROM alert_rows""",
    "row_keys": "SELECT idempotency_key, row_key FROM frames",
    "row_key_parse": "SELECT idempotency_key, unix_ms FROM frames",
    "frames_upsert": f"""
        SELECT {FLAT}, row_key
        FROM (SELECT agent_id, unix_ms, any_value(row_key) AS row_key, arg_max(fleet_id, arrival_seq) AS fleet_id,
                     make_timestamp(unix_ms * 1000) AS collected_at,
                     arg_max(idempotency_key, arrival_seq) || '/1' AS idempotency_key,
                     arg_max(labels, arrival_seq) AS labels,
                     arg_max(cpu, arrival_seq) FILTER (WHERE has_system) AS cpu,
                     arg_max(memory_used_bytes, arrival_seq) FILTER (WHERE has_system) AS memory_used_bytes,
                     arg_max(memory_total_bytes, arrival_seq) FILTER (WHERE has_system) AS memory_total_bytes,
                     arg_max(disk_io_read_mbps, arrival_seq) FILTER (WHERE has_system) AS disk_io_read_mbps,
                     arg_max(disk_io_write_mbps, arrival_seq) FILTER (WHERE has_system) AS disk_io_write_mbps,
                     arg_max(rx_mbps, arrival_seq) FILTER (WHERE has_network) AS rx_mbps,
                     arg_max(tx_mbps, arrival_seq) FILTER (WHERE has_network) AS tx_mbps,
                     arg_max(tcp_retransmit_count, arrival_seq) FILTER (WHERE has_network) AS tcp_retransmit_count,
                     arg_max(connection_count, arrival_seq) FILTER (WHERE has_network) AS connection_count
              FROM frames GROUP BY agent_id, unix_ms)""",
    "agent_scan": """
        SELECT row_key, idempotency_key, round(cpu, 9) AS cpu FROM store
        WHERE starts_with(row_key, 'agent-8#') ORDER BY row_key LIMIT 20""",
    "retention": """
        SELECT row_key, version::INT AS version, idempotency_key, arrival_seq,
               CASE WHEN version = 1 AND fresh_cells THEN round(last_cpu, 9) END AS cpu,
               CASE WHEN version = 1 AND fresh_cells THEN last_conn END::DOUBLE AS connection_count
        FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY arrival_seq DESC) AS version,
                     max_by(cpu, CASE WHEN has_system THEN arrival_seq END) OVER (PARTITION BY row_key) AS last_cpu,
                     max_by(connection_count, CASE WHEN has_network THEN arrival_seq END)
                         OVER (PARTITION BY row_key) AS last_conn,
                     unix_ms >= epoch_ms(TIMESTAMP '2024-02-10') - 30 * 86400000::BIGINT AS fresh_cells
              FROM deliveries WHERE unix_ms >= epoch_ms(TIMESTAMP '2024-02-10') - 35 * 86400000::BIGINT)
        WHERE version <= 2""",
    "recent_n": "SELECT agent_id, rn::INT AS rn, row_key, idempotency_key FROM store WHERE rn <= 10",
    "agent_recent_summary": """
        SELECT agent_id, round(coalesce(avg(cpu), 0.0), 9) AS avg_cpu, max(unix_ms) AS last_seen_ms
        FROM store WHERE rn <= 10 GROUP BY ALL""",
    "agent_state_latest": "SELECT fleet_id, agent_id, cpu, last_seen_ms, status FROM state",
    "agent_state_active": """
        SELECT fleet_id, agent_id, cpu, last_seen_ms, status FROM state
        WHERE epoch_ms(TIMESTAMP '2024-01-30 20:00:00') - last_seen_ms <= 3600000""",
    "fleet_status_agents": """
        SELECT fleet_id, last_n_rows, agent_id, round(avg_cpu_utilization_pct, 9) AS avg_cpu_utilization_pct,
               last_seen_unix_ms, status FROM agents
        UNION ALL
        SELECT fleet_id, last_n_rows, 'no-active-agents', 0.0, epoch_ms(TIMESTAMP '2024-01-30 20:00:00'), 1
        FROM requests WHERE fleet_id NOT IN (SELECT fleet_id FROM agents)""",
    "fleet_lookup": "SELECT fleet_id, agent_id, cpu, last_seen_ms, status FROM state WHERE fleet_id = 'fleet-5'",
    "fleet_status_summary": """
        SELECT r.fleet_id, r.last_n_rows, count(a.agent_id) AS active_agent_count
        FROM requests r LEFT JOIN agents a ON a.fleet_id = r.fleet_id GROUP BY ALL""",
    "fleet_status_json": "SELECT fleet_id, last_n_rows, document FROM documents_json",
    "fleet_status_placeholder_json": """
        SELECT fleet_id, last_n_rows, '{"fleetId":"' || fleet_id || '","activeAgentCount":1,"agents":[{"agentId":'
               || '"no-active-agents","avgCpuUtilizationPct":0.0,"lastSeenUnixMs":"' || epoch_ms(TIMESTAMP '2024-01-30 20:00:00')
               || '","status":"SEVERITY_INFO"}],"asOf":"2024-01-30T20:00:00.000000Z"}' AS document
        FROM requests WHERE fleet_id NOT IN (SELECT fleet_id FROM state)""",
    "fleet_status_large_n": """
        SELECT s.fleet_id, n AS last_n_rows, s.agent_id, round(coalesce(avg(t.cpu), 0.0), 9) AS avg_cpu_utilization_pct,
               max(t.unix_ms) AS last_seen_unix_ms, s.status
        FROM state s CROSS JOIN (SELECT unnest([3, 30, 5000])::INT AS n) JOIN store t ON t.agent_id = s.agent_id AND t.rn <= n
        GROUP BY ALL""",
    "fleet_windows_no_time": f"""
        {_windows("(SELECT * REPLACE (CASE WHEN arrival_seq % 41 <> 0 THEN collected_at ELSE received_at END AS collected_at) FROM flagged)", "1 minute")}""",
    "fleet_windows_60s": f"""
        SELECT * REPLACE (strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start,
                          strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') AS window_end)
        FROM ({_windows("flagged", "1 minute")})""",
    "fleet_windows_1d": _windows("flagged", "1 day", ", max(cpu0) AS max_cpu"),
    "fleet_region_day": """
        SELECT collected_at::DATE::VARCHAR AS window_date, region, fleet_id, count(*) AS anomaly_count,
               round(avg(cpu0), 9) AS avg_cpu_during_anomalies
        FROM flagged WHERE is_anomaly GROUP BY ALL""",
    "latency_histogram": """
        SELECT method, CASE WHEN isinf(le) THEN '+Inf' ELSE le::VARCHAR END AS le,
               count(*) FILTER (WHERE duration_s <= le) AS cumulative, count(*) AS count,
               round(sum(duration_s), 9) AS sum
        FROM rpc, bounds GROUP BY method, bounds.le""",
    "sink_histogram": """
        SELECT CASE WHEN isinf(le) THEN '+Inf' ELSE le::VARCHAR END AS le,
               count(*) FILTER (WHERE duration_s <= le) AS cumulative, count(*) AS count,
               round(sum(duration_s), 9) AS sum
        FROM rpc, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'inf'::DOUBLE]
                   ::DOUBLE[]) AS le) b
        GROUP BY b.le""",
    "latency_p99": _p99("minute"),
    "latency_p99_1d": _p99("day"),
    "latency_quantiles": " UNION ALL ".join(
        f"SELECT method, {p}::DOUBLE AS probability, round(quantile_cont(duration_s, {p}), 9) AS value FROM rpc GROUP BY ALL"
        for p in (0.5, 0.9, 0.95, 0.99)
    ),
    "load_report": """
        SELECT section, metric, round(value, 9) AS value FROM (
            SELECT 'summary' AS section, 'count' AS metric, count(*)::DOUBLE AS value FROM rpc
            UNION ALL SELECT 'summary', 'total', (epoch_us(max(ended_at)) - epoch_us(min(started_at))) / 1e6 FROM rpc
            UNION ALL SELECT 'summary', 'average', avg(duration_s) FROM rpc
            UNION ALL SELECT 'summary', 'fastest', min(duration_s) FROM rpc
            UNION ALL SELECT 'summary', 'slowest', max(duration_s) FROM rpc
            UNION ALL SELECT 'summary', 'rps',
                count(*) / ((epoch_us(max(ended_at)) - epoch_us(min(started_at))) / 1e6) FROM rpc
            UNION ALL SELECT 'latency', 'p50.0', quantile_cont(duration_s, 0.5) FROM rpc
            UNION ALL SELECT 'latency', 'p90.0', quantile_cont(duration_s, 0.9) FROM rpc
            UNION ALL SELECT 'latency', 'p95.0', quantile_cont(duration_s, 0.95) FROM rpc
            UNION ALL SELECT 'latency', 'p99.0', quantile_cont(duration_s, 0.99) FROM rpc
            UNION ALL SELECT 'status', code, count(*)::DOUBLE FROM rpc GROUP BY code)""",
    "inflight_streams": """
        SELECT bucket_start, sum(sum(delta)) OVER (ORDER BY bucket_start)::BIGINT AS inflight
        FROM (SELECT date_trunc('minute', started_at) AS bucket_start, 1 AS delta FROM rpc
              UNION ALL SELECT date_trunc('minute', ended_at), -1 FROM rpc) GROUP BY bucket_start""",
    "golden_signals": """
        SELECT window_start, method, code, handled, round((sum(CASE WHEN code <> 'OK' THEN handled ELSE 0 END) OVER w)
                   / (sum(handled) OVER w)::DOUBLE, 9) AS error_rate
        FROM (SELECT date_trunc('minute', ended_at) AS window_start, method, code, count(*) AS handled
              FROM rpc GROUP BY ALL)
        WINDOW w AS (PARTITION BY window_start, method)""",
    "message_totals": """
        SELECT fleet_id, count(*) AS received,
               count(*) + count(*) FILTER (WHERE is_anomaly AND NOT is_duplicate) AS sent
        FROM marked GROUP BY ALL""",
    "log_summary": """
        SELECT kind, date_trunc('second', seen) AS second, count(*) AS lines, max(n)::DOUBLE AS active_agents
        FROM (SELECT 'ack' AS kind, CASE WHEN NOT is_duplicate THEN received_at END AS seen, NULL::BIGINT AS n FROM marked
              UNION ALL SELECT 'alert', triggered_at, NULL FROM alert_rows
              UNION ALL SELECT 'status', NULL, count(a.agent_id)
              FROM requests r LEFT JOIN agents a ON a.fleet_id = r.fleet_id GROUP BY r.fleet_id)
        GROUP BY ALL""",
    "stream_ingest_acks": """
        SELECT idempotency_key, CASE WHEN NOT is_duplicate THEN received_at END AS server_received_at FROM marked""",
    "stream_ingest_frames": """
        SELECT row_key, idempotency_key, round(cpu, 9) AS cpu, make_timestamp(unix_ms * 1000)::DATE::VARCHAR AS event_date
        FROM store""",
    "stream_state": """
        SELECT fleet_id, agent_id, arg_max(cpu0, arrival_seq) AS cpu, arg_max(unix_ms, arrival_seq) AS last_seen_ms,
               arg_max(CASE WHEN is_anomaly THEN 3 ELSE 1 END, arrival_seq) AS status
        FROM fresh GROUP BY ALL
        HAVING (SELECT quantile_disc(epoch_us(received_at), 0.5) // 1000 FROM deliveries) - arg_max(unix_ms, arrival_seq) <= 86400000""",
    "region_day_table": """
        SELECT collected_at::DATE::VARCHAR AS window_date, region, fleet_id, count(*) AS anomaly_count,
               round(avg(cpu0), 9) AS avg_cpu_during_anomalies
        FROM flagged WHERE is_anomaly GROUP BY ALL""",
    "stream_late_rows": f"""
        SELECT * FROM ({_windows("kept_late", "1 minute")}) WHERE window_end <= (SELECT high FROM late_mark)""",
    "stream_quarantine": """
        SELECT arrival_seq, CASE WHEN arrival_seq % 97 = 0 THEN '' ELSE 'collected_at' END AS field,
               CASE WHEN arrival_seq % 97 = 0 THEN 'not a JSON frame' ELSE 'not an RFC 3339 time' END AS description
        FROM frames WHERE arrival_seq % 97 = 0 OR arrival_seq % 89 = 0 OR arrival_seq % 83 = 0""",
    "stream_delivered": """
        SELECT alert_id, agent_id, triggered_at FROM routed
        QUALIFY row_number() OVER (PARTITION BY agent_id, date_trunc('minute', triggered_at)
                                   ORDER BY triggered_at, alert_id) <= 10""",
    "stream_fleet_windows": f"""
        SELECT * FROM ({_windows("fresh", "1 minute", at="received_at")})
        WHERE window_end <= (SELECT max(received_at) - INTERVAL 10 MINUTE FROM fresh WHERE is_anomaly)""",
    "stream_dedup": """
        SELECT idempotency_key, agent_id, collected_at FROM deliveries
        QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY arrival_seq) = 1""",
    "stream_swept_keys": "SELECT idempotency_key, bucket, arrival_seq FROM slots JOIN chain USING (idempotency_key, bucket)",
    "fleet_windows_top_label": """
        SELECT fleet_id, window_start, arg_min(event_type, (-used, event_type)) AS top_label,
               round(max(used)::DOUBLE / sum(used)::DOUBLE, 9) AS cpu_share, count(*) AS labels
        FROM (SELECT fleet_id, date_trunc('day', collected_at) AS window_start, event_type,
                     sum(round_even(cpu0 * 1e6, 0)::BIGINT)::BIGINT AS used
              FROM flagged WHERE is_anomaly GROUP BY ALL) GROUP BY ALL""",
    "latency_sketches": """
        SELECT method, window_start, unnest([0.5, 0.95, 0.99])::DOUBLE AS probability, n, true AS within
        FROM (SELECT method, date_trunc('day', ended_at) AS window_start, count(duration_s) AS n FROM rpc GROUP BY ALL)""",
    "stream_region_day_rollup": """
        SELECT collected_at::DATE::VARCHAR AS window_date, region, fleet_id, count(*) AS anomaly_count,
               round(avg(cpu0), 9) AS avg_cpu_during_anomalies
        FROM flagged WHERE is_anomaly GROUP BY ALL""",
    "stream_windows_kept": f"""
        SELECT * FROM ({_windows("on_time", "1 minute")}) WHERE window_end <= (SELECT high FROM late_mark)""",
    "stream_late_table": """
        SELECT fleet_id, agent_id, collected_at AS event_time, round(cpu0, 9) AS cpu,
               time_bucket(INTERVAL '1 minute', collected_at) AS window_start
        FROM late WHERE is_anomaly AND arrival_seq NOT IN (SELECT arrival_seq FROM on_time)""",
    "agent_scan_indexed": """
        SELECT row_key, idempotency_key, round(cpu, 9) AS cpu FROM store
        WHERE starts_with(row_key, 'agent-8#') ORDER BY row_key LIMIT 20""",
    "retention_in_place": """
        SELECT row_key, idempotency_key, arrival_seq,
               CASE WHEN version = 1 AND fresh_cells THEN round(last_cpu, 9) END AS cpu,
               CASE WHEN version = 1 AND fresh_cells THEN last_conn END::DOUBLE AS connection_count
        FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY arrival_seq DESC) AS version,
                     max_by(cpu, CASE WHEN has_system THEN arrival_seq END) OVER (PARTITION BY row_key) AS last_cpu,
                     max_by(connection_count, CASE WHEN has_network THEN arrival_seq END)
                         OVER (PARTITION BY row_key) AS last_conn,
                     unix_ms >= epoch_ms(TIMESTAMP '2024-02-10') - 30 * 86400000::BIGINT AS fresh_cells
              FROM deliveries WHERE unix_ms >= epoch_ms(TIMESTAMP '2024-02-10') - 35 * 86400000::BIGINT)
        WHERE version <= 2""",
    "stream_redelivery": """
        SELECT alert_id, CASE WHEN alert_id >= '1' AND alert_id < '2' THEN 'parked' ELSE 'delivered' END AS outcome FROM alert_rows""",
    "stream_live_routing": """
        SELECT alert_id, agent_id, triggered_at, subscribed_at FROM routed
        WHERE epoch_us(triggered_at) < (SELECT epoch_ms(max(triggered_at)) * 1000 FROM alert_rows)""",
    "stream_agent_evictions": """
        SELECT fleet_id, agent_id, round(cpu, 9) AS cpu, last_seen_ms, status, due * 600000 AS evicted_ms
        FROM (SELECT *, greatest(slot + 1, (last_seen_ms + 3600000) // 600000 + 1) AS due,
                     lead(slot) OVER (PARTITION BY fleet_id, agent_id ORDER BY slot) AS following
              FROM (SELECT fleet_id, agent_id, epoch_ms(received_at) // 600000 AS slot, arg_max(cpu0, arrival_seq) AS cpu,
                           arg_max(unix_ms, arrival_seq) AS last_seen_ms,
                           arg_max(CASE WHEN is_anomaly THEN 3 ELSE 1 END, arrival_seq)::INT AS status
                    FROM (SELECT *, arg_max(arrival_seq, (received_at, arrival_seq))
                              OVER (PARTITION BY fleet_id, agent_id, epoch_ms(received_at) // 600000) AS latest FROM flagged)
                    WHERE arrival_seq = latest GROUP BY ALL))
        WHERE following >= due OR (following IS NULL AND due * 600000 < (SELECT epoch_ms(max(received_at)) FROM flagged))""",
}


def _with(body: str) -> str:
    """The query with the expressions it can use; unused ones cost nothing."""
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items())
    return f"WITH RECURSIVE {parts}\n{body}"


ORACLE: dict[str, str] = {name: _with(body) for name, body in BODIES.items()}
