"""DuckDB SQL of the flow queries, built from shared common table expressions."""

from __future__ import annotations

from flowloom.functions.packets import KEYED_SQL, PACKETS_SQL
from flowloom.operators.flows import EVENT_LIMITS, FEATURES

L = EVENT_LIMITS
PART = "PARTITION BY capture_file, lo, hi, proto"
INST = "PARTITION BY capture_file, lo, hi, proto, instance"

SESSIONS_SQL = f"""sessions AS (
  SELECT *, CAST(sum(fresh) OVER ({PART} ORDER BY pkt_no) AS BIGINT) AS instance FROM (
    SELECT *, CASE WHEN coalesce(ts_us - lag(ts_us) OVER ({PART} ORDER BY pkt_no) >= {L.timeout_us}, true) THEN 1 ELSE 0 END AS fresh FROM keyed)
)"""

INTERVALS_SQL = f"""iv AS (
  SELECT *, CASE WHEN first_of AND run > 0 THEN run / 1e6 END AS active, CASE WHEN iat_us > {L.idle_us} THEN iat_us / 1e6 END AS idle, iat_us / 1e6 AS iat FROM (
    SELECT *, sum(CASE WHEN iat_us <= {L.idle_us} THEN iat_us END) OVER ({INST}, island) AS run,
      row_number() OVER ({INST}, island ORDER BY pkt_no) = 1 AS first_of FROM (
      SELECT *, sum(CASE WHEN iat_us > {L.idle_us} THEN 1 ELSE 0 END) OVER ({INST} ORDER BY pkt_no) AS island,
        CASE WHEN fwd THEN (ts_us - last_value(CASE WHEN fwd THEN ts_us END IGNORE NULLS) OVER ({INST} ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6 END AS iat_f,
        CASE WHEN NOT fwd THEN (ts_us - last_value(CASE WHEN NOT fwd THEN ts_us END IGNORE NULLS) OVER ({INST} ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6 END AS iat_b
      FROM (SELECT *, up = first_value(up) OVER ({INST} ORDER BY pkt_no) AS fwd, ts_us - lag(ts_us) OVER ({INST} ORDER BY pkt_no) AS iat_us FROM sessions)))
)"""


def _stats(name: str, x: str, order: tuple[str, ...]) -> str:
    by = {"max": "max", "min": "min", "mean": "avg", "std": "stddev_samp"}
    return ", ".join(f"coalesce({by[s]}({x}), 0) AS {name}_{s}" for s in order)


def _count(cond: str, name: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS DOUBLE) AS {name}"


def _flag(mask: int) -> str:
    return f"proto = 6 AND tcp_flags & {mask} <> 0"


LEN, IAT = ("max", "min", "mean", "std"), ("mean", "std", "max", "min")
FLOWS_SQL = f"""raw_flows AS (
  SELECT capture_file, lo, hi, proto, instance, min_by(src, pkt_no) AS src_ip, min_by(dst, pkt_no) AS dst_ip, min_by(sport, pkt_no) AS src_port, min_by(dport, pkt_no) AS dst_port,
    min_by(ts_us, pkt_no) AS start_us, max_by(ts_us, pkt_no) AS end_us, count(*) AS n_packets, CAST(proto AS DOUBLE) AS protocol,
    (max_by(ts_us, pkt_no) - min_by(ts_us, pkt_no)) / 1e6 AS flow_duration_s,
    {_count('fwd', 'fwd_packets')}, {_count('NOT fwd', 'bwd_packets')},
    coalesce(sum(CASE WHEN fwd THEN incl_len END), 0) AS fwd_bytes, coalesce(sum(CASE WHEN NOT fwd THEN incl_len END), 0) AS bwd_bytes,
    {_stats('fwd_len', 'CASE WHEN fwd THEN incl_len END', LEN)}, {_stats('bwd_len', 'CASE WHEN NOT fwd THEN incl_len END', LEN)}, {_stats('pkt_len', 'incl_len', LEN)},
    {_stats('flow_iat', 'iat', IAT)}, {_stats('fwd_iat', 'iat_f', IAT)}, {_stats('bwd_iat', 'iat_b', IAT)},
    CASE WHEN count(iat_f) > 0 THEN (max_by(ts_us, pkt_no) FILTER (WHERE fwd) - min_by(ts_us, pkt_no)) / 1e6 ELSE 0 END AS fwd_iat_total,
    CASE WHEN count(iat_b) > 0 THEN (max_by(ts_us, pkt_no) FILTER (WHERE NOT fwd) - min_by(ts_us, pkt_no)) / 1e6 ELSE 0 END AS bwd_iat_total,
    {_count(f'{_flag(8)} AND fwd', 'fwd_psh')}, {_count(f'{_flag(8)} AND NOT fwd', 'bwd_psh')}, {_count(f'{_flag(32)} AND fwd', 'fwd_urg')}, {_count(f'{_flag(32)} AND NOT fwd', 'bwd_urg')},
    {', '.join(_count(_flag(1 << k), f'{n}_count') for k, n in enumerate(('fin', 'syn', 'rst', 'psh', 'ack', 'urg', 'ece', 'cwr')))},
    coalesce(sum(CASE WHEN fwd THEN ip_hdr_len + l4_hdr_len END), 0) AS fwd_header_bytes, coalesce(sum(CASE WHEN NOT fwd THEN ip_hdr_len + l4_hdr_len END), 0) AS bwd_header_bytes,
    coalesce(min_by(win, pkt_no) FILTER (WHERE fwd AND proto = 6), 0) AS init_fwd_win, coalesce(min_by(win, pkt_no) FILTER (WHERE NOT fwd AND proto = 6), 0) AS init_bwd_win,
    {_count('fwd AND payload_len > 0', 'fwd_data_pkts')}, {_count('NOT fwd AND payload_len > 0', 'bwd_data_pkts')},
    {_stats('active', 'active', IAT)}, {_stats('idle', 'idle', IAT)},
    coalesce(avg(CASE WHEN fwd AND proto = 6 THEN win END), 0) AS fwd_win_mean, coalesce(avg(CASE WHEN NOT fwd AND proto = 6 THEN win END), 0) AS bwd_win_mean
  FROM iv GROUP BY capture_file, lo, hi, proto, instance
), flows AS (
  SELECT *, CASE WHEN fwd_packets > 0 THEN bwd_packets / fwd_packets ELSE 0 END AS down_up_ratio,
    (fwd_bytes + bwd_bytes) / (fwd_packets + bwd_packets) AS avg_pkt_size,
    CASE WHEN fwd_packets > 0 THEN fwd_bytes / fwd_packets ELSE 0 END AS avg_fwd_seg, CASE WHEN bwd_packets > 0 THEN bwd_bytes / bwd_packets ELSE 0 END AS avg_bwd_seg,
    CASE WHEN flow_duration_s > 0 THEN (fwd_bytes + bwd_bytes) / flow_duration_s ELSE 0 END AS flow_bytes_s,
    CASE WHEN flow_duration_s > 0 THEN n_packets / flow_duration_s ELSE 0 END AS flow_packets_s
  FROM raw_flows
)"""

#: Closed flows as the aggregates take them.
CLOSED_SQL = """closed AS (
  SELECT src_ip AS src, dst_ip AS dst, src_port, dst_port, start_us, end_us, n_packets, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes, CAST(bwd_bytes AS DOUBLE) AS bwd_bytes,
    proto = 6 AND syn_count > 0 AND ack_count = 0 AS syn_only, proto = 6 AND rst_count > 0 AS rst_seen, proto, syn_count, rst_count, flow_packets_s, flow_duration_s,
    capture_file || '|' || lo || '|' || hi || '|' || CAST(instance AS VARCHAR) AS flow_no, floor(end_us / 1e6 / 86400) * 86400 AS bucket
  FROM flows
)"""

BASE = f"{PACKETS_SQL}, {KEYED_SQL}"
TO_FLOWS = f"{BASE}, {SESSIONS_SQL}, {INTERVALS_SQL}, {FLOWS_SQL}"
TO_CLOSED = f"{TO_FLOWS}, {CLOSED_SQL}"
FEATURE_COLS = ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in FEATURES)


def ordered() -> str:
    """Packets with a row number within their key, for recursive folds."""
    return f"ranked AS (SELECT *, row_number() OVER ({PART} ORDER BY pkt_no) AS rn FROM keyed)"


#: Instances by sweeps and caps: a recursive walk along each key.
INSTANCES_SQL = f"""swept AS (
  SELECT k.*, row_number() OVER ({PART} ORDER BY k.pkt_no) AS rn,
    coalesce(k.pkt_no - k.pkt_no % {L.sweep_every} > lag(k.pkt_no) OVER ({PART} ORDER BY k.pkt_no) AND sweep_us - lag(k.ts_us) OVER ({PART} ORDER BY k.pkt_no) >= {L.timeout_us}, false) AS split
  FROM keyed k LEFT JOIN (SELECT capture_file AS of_capture, pkt_no AS sweep_no, ts_us AS sweep_us FROM packets) s ON of_capture = k.capture_file AND sweep_no = k.pkt_no - k.pkt_no % {L.sweep_every}
), walk AS (
  SELECT capture_file, lo, hi, proto, rn, pkt_no, ts_us, CAST(1 AS BIGINT) AS instance, ts_us AS start_us, 1 AS n FROM swept WHERE rn = 1
  UNION ALL
  SELECT s.capture_file, s.lo, s.hi, s.proto, s.rn, s.pkt_no, s.ts_us,
    CASE WHEN s.split OR w.n >= {L.packet_cap} OR w.ts_us - w.start_us >= {L.activity_cap_us} THEN w.instance + 1 ELSE w.instance END,
    CASE WHEN s.split OR w.n >= {L.packet_cap} OR w.ts_us - w.start_us >= {L.activity_cap_us} THEN s.ts_us ELSE w.start_us END,
    CASE WHEN s.split OR w.n >= {L.packet_cap} OR w.ts_us - w.start_us >= {L.activity_cap_us} THEN 1 ELSE w.n + 1 END
  FROM walk w JOIN swept s ON s.capture_file = w.capture_file AND s.lo = w.lo AND s.hi = w.hi AND s.proto = w.proto AND s.rn = w.rn + 1
)"""


def reanchor_sql(width_us: int) -> str:
    return f"""{ordered()}, walk AS (
  SELECT capture_file, lo, hi, proto, rn, pkt_no, ts_us, CAST(1 AS BIGINT) AS win_no, ts_us AS start_us FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.capture_file, r.lo, r.hi, r.proto, r.rn, r.pkt_no, r.ts_us, CASE WHEN r.ts_us > w.start_us + {width_us} THEN w.win_no + 1 ELSE w.win_no END, CASE WHEN r.ts_us > w.start_us + {width_us} THEN r.ts_us ELSE w.start_us END
  FROM walk w JOIN ranked r ON r.capture_file = w.capture_file AND r.lo = w.lo AND r.hi = w.hi AND r.proto = w.proto AND r.rn = w.rn + 1
)"""


def early_sql(width_us: int) -> str:
    fresh = f"(NOT w.active AND (r.ts_us - w.last_us >= {L.timeout_us} OR r.ts_us - w.start_us >= {L.activity_cap_us} OR w.n >= {L.packet_cap}))"
    add = f"(w.active AND r.ts_us <= w.start_us + {width_us})"
    return f"""{ordered()}, walk AS (
  SELECT capture_file, lo, hi, proto, rn, pkt_no, ts_us, CAST(1 AS BIGINT) AS number, CAST(1 AS BIGINT) AS win_no, true AS active, ts_us AS start_us, ts_us AS last_us, 1 AS n FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.capture_file, r.lo, r.hi, r.proto, r.rn, r.pkt_no, r.ts_us, CASE WHEN {fresh} THEN w.number + 1 ELSE w.number END, CASE WHEN {fresh} THEN w.number + 1 WHEN {add} THEN w.number ELSE 0 END,
    {fresh} OR {add}, CASE WHEN {fresh} THEN r.ts_us ELSE w.start_us END,
    CASE WHEN {fresh} OR {add} THEN r.ts_us WHEN w.active THEN w.last_us ELSE greatest(w.last_us, r.ts_us) END,
    CASE WHEN {fresh} THEN 1 WHEN {add} THEN w.n + 1 ELSE w.n END
  FROM walk w JOIN ranked r ON r.capture_file = w.capture_file AND r.lo = w.lo AND r.hi = w.hi AND r.proto = w.proto AND r.rn = w.rn + 1
)"""
