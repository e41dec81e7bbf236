"""Roll-ups of alerts into the dashboard document, and its sink.

``alerts``: ``seq, ts, risk, threat_class, subtype, src, dst, stage, technique, pps``; ``ts`` in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.detectors import TECHNIQUES, event_severity, host_state, severity
from flowloom.operators.ranks import with_rank


def number(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """A finite number or null, clamped to the bounds given."""
    v = x.try_cast("double")
    v = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    v = v if lo is None else F.when(v.isNotNull(), F.greatest(v, F.lit(lo)))
    return v if hi is None else F.when(v.isNotNull(), F.least(v, F.lit(hi)))


def duration_text(seconds: Column) -> Column:
    return F.when(seconds >= 1, F.format_string("%.0fs", seconds.cast("double"))).when(seconds > 0, "<1s").otherwise("-")


def risk_buckets(alerts: DataFrame, width_s: float = 10.0, keep: int = 180) -> DataFrame:
    """The latest ``keep`` buckets: highest risk, alerts, packet rate, and the last alert's stage and technique."""
    out = alerts.withColumn("bucket", F.floor(F.col("ts") / width_s) * F.lit(width_s)).groupBy("bucket").agg(
        F.max("risk").alias("risk"), F.count("*").alias("alerts"), F.max("pps").alias("pps"),
        F.max_by("stage", "seq").alias("stage"), F.max_by("technique", "seq").alias("technique"), F.max_by("dst", "seq").alias("target"),
    )
    return out.withColumn("second_of_day", F.pmod(F.col("bucket"), F.lit(86400.0))).orderBy(F.desc("bucket")).limit(keep)


def host_rollup(alerts: DataFrame) -> DataFrame:
    out = alerts.groupBy(F.col("src").alias("host")).agg(
        F.max("risk").alias("peak"), F.array_join(F.array_sort(F.collect_set("threat_class")), "/").alias("tech"), F.count("*").alias("alerts"), F.min_by("dst", "seq").alias("first_dst")
    )
    return out.select("host", F.round("peak", 4).alias("risk"), "tech", "alerts", "first_dst").withColumn("state", host_state(F.col("risk")))


def incident_rollup(alerts: DataFrame, keep: int = 20) -> DataFrame:
    """Incidents by class, subtype and source, numbered as first seen; the latest ``keep`` of them."""
    out = alerts.groupBy("threat_class", "subtype", "src").agg(
        F.min("seq").alias("first_seq"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"), F.max("risk").alias("peak"), F.count("*").alias("alerts"), F.min_by("dst", "seq").alias("dst")
    )
    out = with_rank(out.select("first_seq", "threat_class", "subtype", "src", "first_ts", "last_ts", "peak", "alerts", "dst"), ["first_seq"], "no")
    out = out.withColumn("inc_id", F.format_string("INC-%04d", "no")).orderBy(F.desc("first_seq")).limit(keep)
    tid = F.create_map(*[x for k, v in TECHNIQUES.items() for x in (F.lit(k), F.lit(v))])
    return out.select("inc_id", severity(F.col("peak")).alias("sev"), F.coalesce(tid[F.col("threat_class")], F.lit("T1498")).alias("tid"), F.coalesce("subtype", "threat_class").alias("tech"), F.coalesce("dst", "src").alias("target"), F.col("src").alias("ip"), F.round("peak", 4).alias("peak"), duration_text(F.col("last_ts") - F.col("first_ts")).alias("dur"), "alerts")


def with_analyst_status(incidents: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Statuses that analysts set, kept across emits; ``sidecar``: ``inc_id, status, analyst``."""
    out = incidents.join(sidecar, "inc_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("TRIAGING"))).withColumn("analyst", F.left(F.coalesce("analyst", F.lit("")), F.lit(40)))


def latest_events(alerts: DataFrame, keep: int = 50) -> DataFrame:
    message = F.format_string("%s/%s risk=%.3f -> %s", "threat_class", "subtype", "risk", F.coalesce("dst", F.lit("-")))
    return alerts.orderBy(F.desc("seq")).limit(keep).select("seq", "ts", event_severity(F.col("risk")).alias("sev"), F.col("src").alias("host"), message.alias("msg"))


def overview(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.coalesce(F.max("risk"), F.lit(0.0)).alias("max_risk"), F.array_join(F.array_sort(F.collect_set("threat_class")), ",").alias("classes"), F.count("*").alias("alerts"))


def document(alerts: DataFrame, mode: str = "REPLAY", source: str = "spark", sidecar: DataFrame | None = None) -> DataFrame:
    """The whole document as one JSON row; every section is bounded by its ``keep``. Null fields are left out.

    ``sidecar``: statuses that analysts set, which incidents keep.
    """

    def section(df: DataFrame, name: str, order: str) -> DataFrame:
        rest = [c for c in df.columns if c != order]
        return df.agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))

    incidents = incident_rollup(alerts) if sidecar is None else with_analyst_status(incident_rollup(alerts), sidecar)
    parts = [section(risk_buckets(alerts), "windows", "bucket"), section(incidents, "incidents", "inc_id"), section(latest_events(alerts), "events", "seq")]
    hosts = section(host_rollup(alerts).orderBy(F.desc("risk"), "host").limit(200), "hosts", "host")
    out = overview(alerts).select(F.struct("max_risk", "classes", "alerts").alias("overview"))
    for p in (*parts, hosts):
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out.select(F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(source).alias("source"), "overview", "windows", "hosts", "incidents", "events")).alias("document"))


def write_document(doc: DataFrame, path: str) -> None:
    """Writes the document beside ``path`` and renames it over in one step, so that readers always find a whole one."""
    spark = doc.sparkSession
    text = doc.first()["document"]
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, part = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), options)
