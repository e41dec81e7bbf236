"""Queries over scans, captures, generated scenarios and bounded buffers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.functions.packets import packets
from flowloom.plans.flow_sql import BASE
from flowloom.plans.registry import query, table
from flowloom.sources.scenarios import START, scenarios


@query("SELECT event_id, user_id % 10 AS capture, value FROM events WHERE event_type IN ('view', 'error') AND value >= 5")
def flow_table_scan(spark, sf_dir):
    """Column pruning and a membership filter; both reach the scan where the capture is a column."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return e.where(F.col("event_type").isin("view", "error") & (F.col("value") >= 5)).select("event_id", (F.col("user_id") % 10).alias("capture"), "value")


@query(f"WITH {BASE} SELECT user_id % 10 AS capture, min(CASE WHEN proto = 6 THEN 'tcp' ELSE 'udp' END) AS family, min(ts_us) AS first_us, count(*) AS n_flows, CAST(sum(incl_len) AS BIGINT) AS n_bytes FROM packets GROUP BY 1")
def capture_metadata(spark, sf_dir):
    family = F.when(F.col("proto") == 6, "tcp").otherwise("udp")
    return packets(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("capture")).agg(F.min(family).alias("family"), F.min("ts_us").alias("first_us"), F.count("*").alias("n_flows"), F.sum("incl_len").alias("n_bytes"))


@query("SELECT count(*) AS num_rows FROM lineitem")
def footer_row_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("num_rows"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 8")
def last_n_buffer(spark, sf_dir):
    """The latest rows of each key, as bounded buffers keep them; the limit is applied before the shuffle too."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("rn", F.row_number().over(w)).where("rn <= 8").drop("rn")


@query("WITH t AS (SELECT event_id, floor(epoch_us(ts) / 21600000000) AS batch FROM events), r AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY event_id) AS rn FROM t) SELECT CAST(batch AS BIGINT) AS batch, count(*) FILTER (WHERE rn <= 50) AS accepted, count(*) FILTER (WHERE rn > 50) AS dropped FROM r GROUP BY 1")
def bus_overflow(spark, sf_dir):
    """A bus of 50 places a batch drops the newest; the counts need no order within a batch."""
    batch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000)
    n = table(spark, sf_dir, "events").groupBy(batch.alias("batch")).agg(F.count("*").alias("n"))
    return n.select("batch", F.least("n", F.lit(50)).cast("long").alias("accepted"), F.greatest(F.col("n") - 50, F.lit(0)).cast("long").alias("dropped"))


@query(f"""WITH s AS (
  SELECT 'benign' AS scenario, range AS id, {START} + range * 700000 AS ts_us, 200 + range % 300 AS payload_len, 443 AS dport FROM range(40)
  UNION ALL SELECT 'c2', range, {START} + range * 30000000, 64, 443 FROM range(12)
  UNION ALL SELECT 'dga', range, {START} + range * 2000000, 40, 53 FROM range(10)
  UNION ALL SELECT 'tunnel', range, {START} + range * 1000000, 110, 53 FROM range(6)
  UNION ALL SELECT 'scan', range, {START} + range * 50000, 0, 1 + range % 1024 FROM range(30)
  UNION ALL SELECT 'exfil', range, {START} + range * 100000, 1400, 443 FROM range(60)
  UNION ALL SELECT 'tls_rep', range, {START} + range * 5000000, 180, 443 FROM range(8))
SELECT scenario, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS bytes, max(ts_us) - min(ts_us) AS span_us, count(DISTINCT dport) AS ports FROM s GROUP BY scenario""")
def scenario_packets(spark, sf_dir):
    return scenarios(spark).groupBy("scenario").agg(F.count("*").alias("packets"), F.sum("payload_len").alias("bytes"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"), F.count_distinct("dport").alias("ports"))


@query("""WITH d AS (SELECT doc_id, lang, source, length(text) AS n, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents)
SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars, round(sum(digits) / sum(n), 6) AS digit_ratio, max(n) AS longest FROM d GROUP BY lang""")
def text_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"), F.round(F.sum("digits") / F.sum("n"), 6).alias("digit_ratio"), F.max("n").cast("long").alias("longest"))


@query("SELECT label, count(*) AS n, round(avg(list_sum(embedding)), 4) AS mean_sum, round(stddev_samp(list_sum(embedding)), 4) AS std_sum FROM embeddings GROUP BY label")
def label_moments(spark, sf_dir):
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(total), 4).alias("mean_sum"), F.round(F.stddev_samp(total), 4).alias("std_sum"))
