"""Queries over packets and flows: instances, features, windows, duplicates, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.packets import KEY, KEYED_SQL, PACKETS_SQL, has_flag, packets, with_flow_key
from flowloom.operators import audit
from flowloom.operators.flows import EVENT_LIMITS, FEATURES, HOUR, drop_mirrors, ended_by, extract, flow_features, to_float32, window_rows, with_gap_sessions, with_instances, with_intervals
from flowloom.operators.folds import early_step, ordered_fold, reanchor_step
from flowloom.plans.flow_sql import BASE, FEATURE_COLS, FLOWS_SQL, INSTANCES_SQL, INTERVALS_SQL, SESSIONS_SQL, TO_FLOWS, early_sql, reanchor_sql
from flowloom.plans.registry import query

DAY = 24 * HOUR
FLOW_ID = "CAST(proto AS VARCHAR) || '|' || src_ip || '|' || CAST(src_port AS VARCHAR) || '|' || dst_ip || '|' || CAST(dst_port AS VARCHAR) AS flow_id"


def session_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table over gap sessions, with doubles."""
    pk = with_gap_sessions(packets(spark, sf_dir), EVENT_LIMITS.timeout_us)
    return flow_features(with_intervals(pk, EVENT_LIMITS))


@query(f"WITH {TO_FLOWS} SELECT capture_file, lo, hi, proto, instance, n_packets, {FEATURE_COLS} FROM flows")
def flow_features_66(spark, sf_dir):
    return to_float32(session_flows(spark, sf_dir)).select(*KEY, "instance", "n_packets", *FEATURES)


@query(f"WITH {BASE}, {SESSIONS_SQL} SELECT capture_file, lo, hi, proto, instance, count(*) AS n_packets, min(ts_us) AS start_us, max(ts_us) AS end_us FROM sessions GROUP BY ALL")
def flow_sessions_gap(spark, sf_dir):
    pk = with_gap_sessions(packets(spark, sf_dir), EVENT_LIMITS.timeout_us)
    return pk.groupBy(*KEY, "instance").agg(F.count("*").alias("n_packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


@query(f"WITH RECURSIVE {BASE}, {INSTANCES_SQL} SELECT capture_file, lo, hi, proto, rn, split FROM swept")
def flow_sweep_split(spark, sf_dir):
    from flowloom.operators.flows import sweep_flags

    out = sweep_flags(packets(spark, sf_dir), EVENT_LIMITS)
    return out.select(*KEY, F.row_number().over(Window.partitionBy(*KEY).orderBy("pkt_no")).cast("long").alias("rn"), "split")


@query(f"WITH RECURSIVE {BASE}, {INSTANCES_SQL} SELECT capture_file, lo, hi, proto, instance, count(*) AS n_packets, min(pkt_no) AS first_pkt, max(ts_us) - min(ts_us) AS duration_us FROM walk GROUP BY ALL")
def flow_caps_fold(spark, sf_dir):
    pk = with_instances(packets(spark, sf_dir), EVENT_LIMITS)
    return pk.groupBy(*KEY, "instance").agg(F.count("*").alias("n_packets"), F.min("pkt_no").alias("first_pkt"), (F.max("ts_us") - F.min("ts_us")).alias("duration_us"))


@query(f"""WITH RECURSIVE {BASE}, {INSTANCES_SQL}, f AS (
  SELECT capture_file, lo, hi, proto, instance, count(*) AS n_packets, min_by(ts_us, pkt_no) AS start_us, max_by(ts_us, pkt_no) AS end_us FROM walk GROUP BY ALL
), e AS (SELECT capture_file, max_by(ts_us, pkt_no) AS last_us FROM packets GROUP BY capture_file)
SELECT capture_file, lo, hi, proto, instance, CASE WHEN n_packets >= {EVENT_LIMITS.packet_cap} THEN 'packet_cap' WHEN end_us - start_us >= {EVENT_LIMITS.activity_cap_us} THEN 'activity_cap'
  WHEN instance = max(instance) OVER (PARTITION BY capture_file, lo, hi, proto) AND last_us - end_us < {EVENT_LIMITS.timeout_us} AND end_us - start_us < {EVENT_LIMITS.timeout_us} THEN 'capture_end' ELSE 'timeout' END AS ended_by
FROM f JOIN e USING (capture_file)""")
def flow_ended_by(spark, sf_dir):
    pk = packets(spark, sf_dir)
    flows = with_instances(pk, EVENT_LIMITS).groupBy(*KEY, "instance").agg(F.count("*").alias("n_packets"), F.min_by("ts_us", "pkt_no").alias("start_us"), F.max_by("ts_us", "pkt_no").alias("end_us"))
    return ended_by(flows, pk, EVENT_LIMITS).select(*KEY, "instance", "ended_by")


#: Records of the event table: some are no packets, but sweeps and captures' ends count them.
STATUS = "CASE WHEN pkt_no % 11 = 3 THEN 'malformed' ELSE 'parsed' END"


@query(f"""WITH RECURSIVE {PACKETS_SQL.replace('packets AS', 'allpackets AS', 1)}, packets AS (SELECT * FROM allpackets WHERE pkt_no % 11 <> 3), {KEYED_SQL}, {INSTANCES_SQL.replace('FROM packets) s', 'FROM allpackets) s')},
  sessions AS (SELECT s.*, w.instance FROM swept s JOIN walk w USING (capture_file, lo, hi, proto, rn)), {INTERVALS_SQL}, {FLOWS_SQL}, e AS (SELECT capture_file, max_by(ts_us, pkt_no) AS last_us FROM allpackets GROUP BY capture_file)
SELECT capture_file, {FLOW_ID}, CASE WHEN capture_file = 'cap0' THEN 'benign' ELSE 'udp_flood' END AS family, CASE WHEN capture_file = 'cap0' THEN 'benign' ELSE 'attack' END AS binary_label, src_ip, dst_ip, src_port, dst_port,
  start_us / 1e6 AS start_ts, end_us / 1e6 AS end_ts, n_packets, CASE WHEN n_packets >= {EVENT_LIMITS.packet_cap} THEN 'packet_cap' WHEN end_us - start_us >= {EVENT_LIMITS.activity_cap_us} THEN 'activity_cap'
  WHEN instance = max(instance) OVER (PARTITION BY capture_file, lo, hi, proto) AND last_us - end_us < {EVENT_LIMITS.timeout_us} AND end_us - start_us < {EVENT_LIMITS.timeout_us} THEN 'capture_end' ELSE 'timeout' END AS ended_by, {FEATURE_COLS}
FROM flows JOIN e USING (capture_file)""")
def flow_table_job(spark, sf_dir):
    """From records of several captures to the stored flow table: metadata and 66 features."""
    records = packets(spark, sf_dir).withColumn("status", F.expr(STATUS)).withColumn("ip_total", F.col("incl_len")).withColumn("ident", F.col("pkt_no"))
    labels = spark.createDataFrame([("cap0", "benign", "benign"), ("cap1", "udp_flood", "attack"), ("cap2", "udp_flood", "attack")], "capture_file string, family string, binary_label string")
    return extract(records, labels, EVENT_LIMITS)


@query(f"""WITH {TO_FLOWS}, f AS (SELECT capture_file, {FLOW_ID} FROM flows), g AS (SELECT capture_file, flow_id, count(*) AS n FROM f GROUP BY ALL)
SELECT capture_file, CAST(sum(n) AS BIGINT) AS flows, count(*) AS flow_ids, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g GROUP BY capture_file""")
def capture_duplicate_ids(spark, sf_dir):
    port = [F.col(c).cast("string") for c in ("src_port", "dst_port")]
    return audit.capture_duplicates(session_flows(spark, sf_dir).withColumn("flow_id", F.concat_ws("|", F.col("proto").cast("string"), "src_ip", port[0], "dst_ip", port[1])))


@query(f"WITH RECURSIVE {BASE}, {reanchor_sql(DAY)} SELECT capture_file, lo, hi, proto, win_no, count(*) AS n_packets, min(ts_us) AS start_us, max(ts_us) AS end_us FROM walk GROUP BY ALL")
def causal_window_reanchor(spark, sf_dir):
    pk = ordered_fold(with_flow_key(packets(spark, sf_dir)), KEY, ["pkt_no"], ["ts_us"], "win_no", reanchor_step(DAY))
    return pk.groupBy(*KEY, "win_no").agg(F.count("*").alias("n_packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def early_windows(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """Packets in the one causal window of each instance."""
    lim = EVENT_LIMITS
    step = early_step(days * DAY, lim.timeout_us, lim.activity_cap_us, lim.packet_cap)
    return ordered_fold(with_flow_key(packets(spark, sf_dir)), KEY, ["pkt_no"], ["ts_us"], "win_no", step).where("win_no > 0")


def _early(days: int) -> None:
    """Window rows with their features, when they froze, and nothing of what came later."""
    sql = f"""WITH RECURSIVE {BASE}, {early_sql(days * DAY)}, sessions AS (SELECT r.*, w.win_no AS instance FROM ranked r JOIN walk w USING (capture_file, lo, hi, proto, rn) WHERE w.win_no > 0), {INTERVALS_SQL}, {FLOWS_SQL},
  frozen AS (SELECT capture_file, lo, hi, proto, number AS instance, min_by(ts_us, pkt_no) / 1e6 AS frozen_at FROM walk WHERE win_no = 0 GROUP BY ALL)
SELECT capture_file, {FLOW_ID}, instance, n_packets, start_us / 1e6 AS start_ts, end_us / 1e6 AS end_ts, frozen_at, 'window_{days * 86400:g}s' AS ended_by, {FEATURE_COLS} FROM flows LEFT JOIN frozen USING (capture_file, lo, hi, proto, instance)"""

    @query(sql, name=f"early_window_{days}")
    def run(spark, sf_dir):
        out = window_rows(packets(spark, sf_dir), days * DAY, EVENT_LIMITS)
        return out.select("capture_file", "flow_id", "instance", "n_packets", "start_ts", "end_ts", F.when(~F.isnan("_frozen_at"), F.col("_frozen_at")).alias("frozen_at"), "ended_by", *FEATURES)


for _days in (1, 3, 5):
    _early(_days)


@query(f"""WITH RECURSIVE {BASE}, {early_sql(DAY)}, {SESSIONS_SQL}, w AS (SELECT DISTINCT capture_file, lo, hi, proto FROM walk WHERE win_no > 0), t AS (SELECT DISTINCT capture_file, lo, hi, proto FROM sessions WHERE instance > 1)
SELECT (SELECT count(*) FROM t) AS terminal, (SELECT count(*) FROM (SELECT * FROM w INTERSECT SELECT * FROM t)) AS covered, (SELECT count(*) FROM (SELECT * FROM w EXCEPT SELECT * FROM t)) AS uncovered""")
def window_coverage(spark, sf_dir):
    w = early_windows(spark, sf_dir, 1).select(*KEY).distinct()
    t = with_gap_sessions(packets(spark, sf_dir), EVENT_LIMITS.timeout_us).where("instance > 1").select(*KEY).distinct()
    out = t.agg(F.count("*").alias("terminal"))
    out = out.crossJoin(F.broadcast(w.intersect(t).agg(F.count("*").alias("covered"))))  # one row each
    return out.crossJoin(F.broadcast(w.exceptAll(t).agg(F.count("*").alias("uncovered"))))


@query(f"WITH {BASE}, {SESSIONS_SQL}, {INTERVALS_SQL} SELECT capture_file, lo, hi, proto, instance, pkt_no, fwd, iat, iat_f, iat_b FROM iv")
def iat_by_direction(spark, sf_dir):
    pk = with_intervals(with_gap_sessions(packets(spark, sf_dir), EVENT_LIMITS.timeout_us), EVENT_LIMITS)
    return pk.select(*KEY, "instance", "pkt_no", "fwd", "iat", "iat_f", "iat_b")


@query(f"WITH {BASE}, {SESSIONS_SQL}, {INTERVALS_SQL} SELECT capture_file, lo, hi, proto, instance, count(active) AS runs, count(idle) AS gaps, round(coalesce(sum(active), 0), 3) AS active_s, round(coalesce(sum(idle), 0), 3) AS idle_s FROM iv GROUP BY ALL")
def active_idle_periods(spark, sf_dir):
    pk = with_intervals(with_gap_sessions(packets(spark, sf_dir), EVENT_LIMITS.timeout_us), EVENT_LIMITS)
    return pk.groupBy(*KEY, "instance").agg(F.count("active").alias("runs"), F.count("idle").alias("gaps"), F.round(F.coalesce(F.sum("active"), F.lit(0.0)), 3).alias("active_s"), F.round(F.coalesce(F.sum("idle"), F.lit(0.0)), 3).alias("idle_s"))


@query(f"""WITH {BASE} SELECT proto, {', '.join(f"count(CASE WHEN proto = 6 AND tcp_flags & {1 << k} <> 0 THEN 1 END) AS {n}" for k, n in enumerate(('fin', 'syn', 'rst', 'psh', 'ack', 'urg', 'ece', 'cwr')))} FROM packets GROUP BY proto""")
def tcp_flag_counts(spark, sf_dir):
    names = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")
    return packets(spark, sf_dir).groupBy("proto").agg(*[F.count_if(has_flag(1 << k)).alias(n) for k, n in enumerate(names)])


MIRROR = 20 * DAY


@query(f"""WITH RECURSIVE {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_file, proto, src, sport, dst, dport, ip_total, ident ORDER BY pkt_no) AS rn
  FROM (SELECT capture_file, pkt_no, proto, src, sport, dst, dport, ip_hdr_len + l4_hdr_len + payload_len // 100 AS ip_total, k % 2 AS ident, ts_us FROM packets)), walk AS (
  SELECT *, ts_us AS kept_us, CAST(1 AS BIGINT) AS kept FROM r WHERE rn = 1
  UNION ALL SELECT r.*, CASE WHEN abs(r.ts_us - w.kept_us) <= {MIRROR} THEN w.kept_us ELSE r.ts_us END, CASE WHEN abs(r.ts_us - w.kept_us) <= {MIRROR} THEN 0 ELSE 1 END
  FROM walk w JOIN r ON r.capture_file = w.capture_file AND r.proto = w.proto AND r.src = w.src AND r.sport = w.sport AND r.dst = w.dst AND r.dport = w.dport AND r.ip_total = w.ip_total AND r.ident = w.ident AND r.rn = w.rn + 1
) SELECT capture_file, pkt_no FROM walk WHERE kept = 1""")
def mirror_dedup(spark, sf_dir):
    """Frames within the tolerance (twenty days here) of the last kept frame of their identity are mirrors; lengths are coarse here."""
    pk = packets(spark, sf_dir).withColumn("ip_total", F.col("ip_hdr_len") + F.col("l4_hdr_len") + F.floor(F.col("payload_len") / 100)).withColumn("ident", F.col("k") % 2)
    return drop_mirrors(with_flow_key(pk), MIRROR).select("capture_file", "pkt_no")


@query(f"""WITH {BASE}, p AS (SELECT user_id % 10 AS capture, CASE WHEN k % 11 = 0 THEN 'non_ip' WHEN k % 13 = 0 THEN 'malformed' WHEN k % 17 = 0 THEN 'frag' ELSE 'parsed' END AS status FROM packets)
SELECT capture, count(*) AS records, count(*) FILTER (WHERE status = 'parsed') AS parsed, count(*) FILTER (WHERE status = 'non_ip') AS non_ip, count(*) FILTER (WHERE status = 'malformed') AS malformed, count(*) FILTER (WHERE status = 'frag') AS frag, true AS balanced FROM p GROUP BY capture""")
def packet_accounting(spark, sf_dir):
    status = F.when(F.col("k") % 11 == 0, "non_ip").when(F.col("k") % 13 == 0, "malformed").when(F.col("k") % 17 == 0, "frag").otherwise("parsed")
    pk = packets(spark, sf_dir).select((F.col("user_id") % 10).alias("capture"), status.alias("status"))
    return audit.accounting(pk, "capture", "status", ["parsed", "non_ip", "malformed", "frag"])


DUP = ["n_packets", "fwd_bytes", "bwd_bytes", "syn_count"]


@query(f"WITH {TO_FLOWS}, g AS (SELECT count(*) AS n FROM flows GROUP BY n_packets, fwd_bytes, bwd_bytes, syn_count) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g")
def dup_feature_rows(spark, sf_dir):
    return audit.duplicate_rows(session_flows(spark, sf_dir), DUP)


@query(f"WITH {TO_FLOWS} SELECT capture_file, lo, hi, instance, n_packets, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes FROM (SELECT *, row_number() OVER (PARTITION BY n_packets, fwd_bytes, bwd_bytes, syn_count ORDER BY start_us, capture_file, lo, hi) AS rn FROM flows) WHERE rn = 1")
def keep_first_rows(spark, sf_dir):
    return audit.keep_first(session_flows(spark, sf_dir), DUP, ["start_us", "capture_file", "lo", "hi"]).select("capture_file", "lo", "hi", "instance", "n_packets", "fwd_bytes")


@query(f"""WITH {BASE}, d AS (SELECT DISTINCT user_id % 5 AS g, proto, tcp_flags, payload_len, k FROM packets)
SELECT a.g AS group_a, b.g AS group_b, count(*) AS shared FROM d a JOIN d b ON a.proto = b.proto AND a.tcp_flags = b.tcp_flags AND a.payload_len = b.payload_len AND a.k = b.k AND a.g < b.g GROUP BY 1, 2""")
def cross_capture_dups(spark, sf_dir):
    pk = packets(spark, sf_dir).withColumn("g", F.col("user_id") % 5)
    return audit.cross_group_duplicates(pk, "g", ["proto", "tcp_flags", "payload_len", "k"])


PROFILE = ["proto", "tcp_flags", "win", "ip_hdr_len", "l4_hdr_len", "incl_len", "payload_len"]


@query(f"WITH {BASE} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, CAST(0 AS BIGINT) AS not_finite, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, min({c}) = max({c}) AS constant FROM packets" for c in PROFILE))
def constant_columns(spark, sf_dir):
    return audit.column_profile(packets(spark, sf_dir), PROFILE)


@query(f"WITH {BASE} SELECT capture_file, pkt_no FROM (SELECT capture_file, pkt_no, row_number() OVER (ORDER BY pkt_no, capture_file) - 1 AS r, (SELECT greatest(1, count(*) // 500) FROM packets) AS step FROM packets) WHERE r % step = 0")
def systematic_sample(spark, sf_dir):
    return audit.systematic_sample(packets(spark, sf_dir).select("capture_file", "pkt_no"), ["pkt_no", "capture_file"], 500)


@query(f"""WITH {TO_FLOWS}, r AS (SELECT capture_file, lo, hi, proto, instance, sum(incl_len) AS bytes, count(*) AS pkts, (max(ts_us) - min(ts_us)) / 1e6 AS dur FROM sessions GROUP BY ALL), j AS (
  SELECT bytes AS a1, fwd_bytes + bwd_bytes AS b1, pkts AS a2, f.n_packets AS b2, dur AS a3, flow_duration_s * 1.01 AS b3 FROM r JOIN flows f USING (capture_file, lo, hi, proto, instance))
SELECT 'bytes' AS "column", count(*) AS compared, count(*) FILTER (WHERE abs(a1 - b1) > greatest(1, 1e-3 * abs(b1))) AS mismatches FROM j
UNION ALL SELECT 'packets', count(*), count(*) FILTER (WHERE abs(a2 - b2) > greatest(1, 1e-3 * abs(b2))) FROM j
UNION ALL SELECT 'duration', count(*), count(*) FILTER (WHERE abs(a3 - b3) > greatest(1, 1e-3 * abs(b3))) FROM j""")
def rederive_compare(spark, sf_dir):
    """A second derivation of flow totals against the flow table; its durations are off by 1 % on purpose."""
    pk = with_gap_sessions(packets(spark, sf_dir), EVENT_LIMITS.timeout_us)
    again = pk.groupBy(*KEY, "instance").agg(F.sum("incl_len").cast("double").alias("bytes"), F.count("*").cast("double").alias("packets"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration"))
    flows = session_flows(spark, sf_dir).select(*KEY, "instance", (F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes"), F.col("n_packets").cast("double").alias("packets"), (F.col("flow_duration_s") * 1.01).alias("duration"))
    return audit.compare_derivations(again, flows, [*KEY, "instance"], ["bytes", "packets", "duration"])


@query(f"WITH {BASE}, {SESSIONS_SQL}, {INTERVALS_SQL} SELECT proto, round(quantile_cont(iat, 0.5), 6) AS p50, round(quantile_cont(iat, 0.9), 6) AS p90, round(quantile_cont(iat, 0.99), 6) AS p99, max(iat) AS longest FROM iv GROUP BY proto")
def latency_percentiles(spark, sf_dir):
    pk = with_intervals(with_gap_sessions(packets(spark, sf_dir), EVENT_LIMITS.timeout_us), EVENT_LIMITS)
    return pk.groupBy("proto").agg(*[F.round(F.percentile("iat", q), 6).alias(f"p{round(100 * q)}") for q in (0.5, 0.9, 0.99)], F.max("iat").alias("longest"))


