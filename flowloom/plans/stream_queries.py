"""Streaming queries: all available rows are processed; results come back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import detectors as D
from flowloom.operators.flows import EVENT_LIMITS, HOUR
from flowloom.plans.flow_sql import TO_CLOSED, early_sql
from flowloom.plans.registry import query
from flowloom.plans.score_queries import DAY_S, RESULTS_SQL, closed_flows
from flowloom.streaming.processors import causal_windows, cooldowns, guarded_windows, pair_series_stream, sessions, tumbling
from flowloom.streaming.runs import event_stream, run_available, work_folder
from flowloom.streaming.service import Service, Timing, inputs, serve

DAY_US = 24 * HOUR


@query("""WITH w AS (SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start_us + 86400000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")
def tumbling_bucket_stream(spark, sf_dir):
    """Closed daily buckets; those that the watermark has not passed are still open."""
    out = run_available(tumbling(event_stream(spark, sf_dir), "1 day", "1 hour", ["event_type"]))
    return out.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 43200000000, true) THEN 1 ELSE 0 END AS fresh FROM events)),
g AS (SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, no) SELECT * FROM g WHERE end_us <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")
def session_stream(spark, sf_dir):
    out = run_available(sessions(event_stream(spark, sf_dir), "12 hours", "1 hour", "user_id"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), walk AS (
  SELECT user_id, event_id, rn, t AS s, CAST(1 AS BIGINT) AS win_no FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.event_id, r.rn, CASE WHEN r.t > w.s + {DAY_US} THEN r.t ELSE w.s END, CASE WHEN r.t > w.s + {DAY_US} THEN w.win_no + 1 ELSE w.win_no END FROM walk w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT user_id, event_id, win_no FROM walk""")
def stateful_flow_stream(spark, sf_dir):
    return run_available(causal_windows(event_stream(spark, sf_dir), "user_id", DAY_US))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'error'), walk AS (
  SELECT user_id, event_id, rn, t AS last, CAST(1 AS BIGINT) AS emitted FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.event_id, r.rn, CASE WHEN r.t - w.last >= 518400 THEN r.t ELSE w.last END, CASE WHEN r.t - w.last >= 518400 THEN 1 ELSE 0 END FROM walk w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT user_id, event_id, emitted FROM walk""")
def cooldown_stream(spark, sf_dir):
    errors = event_stream(spark, sf_dir).where("event_type = 'error'")
    return run_available(cooldowns(errors, "user_id", 518400.0))


@query("SELECT user_id AS src, event_id % 3 AS dst, count(*) AS events, least(count(*), 16) AS kept, min(epoch_us(ts)) AS first_us FROM events GROUP BY ALL")
def pair_state_stream(spark, sf_dir):
    """The series of every pair after the last batch; at most sixteen starts are kept."""
    rows = event_stream(spark, sf_dir).withWatermark("ts", "1 day").select("ts", F.col("user_id").alias("src"), (F.col("event_id") % 3).alias("dst"), "event_id", F.unix_micros("ts").alias("ts_us"))
    out = run_available(pair_series_stream(rows, 16, 90 * 86_400_000), "update")
    return out.groupBy("src", "dst").agg(F.max("events").alias("events"), F.max("kept").alias("kept"), F.min("first_us").alias("first_us"))


@query(f"WITH RECURSIVE keyed AS (SELECT '' AS capture_file, user_id AS lo, 0 AS hi, 0 AS proto, event_id AS pkt_no, epoch_us(ts) AS ts_us FROM events), {early_sql(DAY_US)} SELECT lo AS user_id, pkt_no AS event_id, win_no FROM walk")
def guarded_window_stream(spark, sf_dir):
    lim = EVENT_LIMITS
    return run_available(guarded_windows(event_stream(spark, sf_dir), "user_id", DAY_US, lim.timeout_us, lim.activity_cap_us, lim.packet_cap))


@query(f"""WITH {TO_CLOSED}, {RESULTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, bucket ORDER BY score DESC, threat_class, subtype) AS rn FROM act),
led AS (SELECT entity, bucket, max(CASE WHEN rn = 1 THEN threat_class END) AS threat_class, max(score) AS score, count(*) - 1 AS n_secondary FROM ranked GROUP BY entity, bucket), hosts AS (SELECT bucket, count(DISTINCT entity) AS h FROM led GROUP BY bucket),
fused AS (SELECT *, row_number() OVER (PARTITION BY threat_class, entity ORDER BY bucket) AS repeats FROM led JOIN hosts USING (bucket))
SELECT bucket, entity AS source_ip, threat_class, repeats, n_secondary, round(least(1.0, score + CASE WHEN repeats >= 2 THEN 0.05 * (repeats - 1) ELSE 0 END + 0.02 * (h - 1)), 4) AS risk FROM fused""")
def service_alerts(spark, sf_dir):
    """The service's alerts over daily buckets of closed flows, fed as a stream of files; two detectors of simple scores."""
    folder = work_folder(spark)
    inputs(closed_flows(spark, sf_dir)).repartition(4).write.parquet(f"{folder}/in")

    def simple(kind, entity, score, subtype):
        return lambda df: df.select(F.lit(kind).alias("threat_class"), F.col(entity).alias("entity"), "bucket", score.alias("score"), score.alias("confidence"), F.lit(subtype).alias("subtype"), F.lit("{}").alias("evidence"), (score >= D.SUSPICIOUS).alias("active"))

    none = {k: lambda df: df.select(*[F.lit(None).cast(t).alias(c) for c, t in zip(D.RESULT, ("string", "string", "double", "double", "double", "string", "string", "boolean"), strict=True)]) for k in ("c2_beacon", "ddos_model")}
    own = {"recon": simple("RECON", "src", F.least(F.lit(1.0), F.col("flows") / 3.0), "SERVICE_DISCOVERY"), "exfil": simple("EXFIL", "host", F.least(F.lit(1.0), F.col("bytes_out") / 400.0), "OUTBOUND_ASYMMETRY")}
    # Files come in any order, so the watermark waits for all of them.
    service = Service(folder, Timing(DAY_S, 1e9, 0.0, 1e9, 0.0, 0.0), "REPLAY", own | none)
    rows = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    serve(rows, service).awaitTermination()
    service.flush(spark, rows.schema)
    return service.alerts(spark).select("bucket", "source_ip", "threat_class", "repeats", F.size("secondary").cast("long").alias("n_secondary"), "risk")
