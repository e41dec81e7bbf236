"""Cross-flow aggregates over closed flows: fan-out, pair series, host volumes, source mix, names, handshakes.

Input ``flows``: ``src, dst, dst_port, start_us, end_us, n_packets, fwd_bytes, bwd_bytes, syn_only, rst_seen``,
one row a closed flow or window. Buckets are tumbling, by the flow's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.packets import bucket_of


def with_bucket(flows: DataFrame, width_s: float) -> DataFrame:
    return flows.withColumn("bucket", bucket_of(F.col("end_us") / 1e6, width_s))


def source_fanout(flows: DataFrame) -> DataFrame:
    """Per source and bucket: distinct hosts and ports, packets, SYN-only and RST flows, flows."""
    return flows.groupBy("src", "bucket").agg(
        F.count_distinct("dst").alias("hosts"),
        F.count_distinct("dst_port").alias("ports"),
        F.sum("n_packets").alias("attempts"),
        F.count_if("syn_only").alias("syn_only"),
        F.count_if("rst_seen").alias("rst_seen"),
        F.count("*").alias("flows"),
    )


def pair_series(flows: DataFrame, most: int = 256) -> DataFrame:
    """Per pair: the first ``most`` start times in order, and bytes both ways.

    Ranks are cut at ``most`` before the rows are dealt, so a busy pair neither moves nor gathers more; bytes
    are summed apart, with partial sums.
    """
    w = Window.partitionBy("src", "dst").orderBy("start_us", "flow_no")
    first = flows.select("src", "dst", "start_us", "flow_no").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    starts = first.groupBy("src", "dst").agg(F.array_sort(F.collect_list("start_us")).alias("starts"))
    sums = flows.groupBy("src", "dst").agg(F.sum("fwd_bytes").cast("long").alias("bytes_out"), F.sum("bwd_bytes").cast("long").alias("bytes_in"))
    on = starts["src"].eqNullSafe(sums["src"]) & starts["dst"].eqNullSafe(sums["dst"])
    return starts.join(sums, on).select(starts["src"], starts["dst"], "starts", "bytes_out", "bytes_in")


def rolling_pairs(flows: DataFrame, width_s: float, ttl_s: float = 900.0) -> DataFrame:
    """Per pair and bucket: the regularity of the pair's start times in the buckets of the last ``ttl_s``, as in ``interval_stats``.

    Events are summed up by bucket first; a bucket then looks back over at most ``ttl_s / width_s`` sums,
    however busy the pair is.
    """
    order = Window.partitionBy("src", "dst").orderBy("bucket", "start_us", "flow_no")
    gap = (F.col("start_us") - F.lag("start_us").over(order)) / 1e6
    rows = flows.select("src", "dst", "bucket", "start_us", "flow_no").withColumn("gap", F.when(gap > 0, gap))
    rows = rows.withColumn("lead", F.row_number().over(Window.partitionBy("src", "dst", "bucket").orderBy("start_us", "flow_no")) == 1)
    inner = F.when(~F.col("lead"), F.col("gap"))
    at = rows.groupBy("src", "dst", "bucket").agg(
        F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"), F.count(inner).alias("g"), F.coalesce(F.sum(inner), F.lit(0.0)).alias("g1"),
        F.coalesce(F.sum(inner * inner), F.lit(0.0)).alias("g2"), F.max(F.when(F.col("lead"), F.col("gap"))).alias("into"),
    )
    back = Window.partitionBy("src", "dst").orderBy(F.round(F.col("bucket") * 1e6).cast("long")).rangeBetween(-round(ttl_s * 1e6), 0)
    # The gap into the first bucket belongs to an event before it.
    edge = F.min(F.struct("bucket", "into")).over(back)["into"]
    into = F.coalesce("into", F.lit(0.0))
    out = at.withColumn("_edge", edge).select(
        "src", "dst", "bucket", F.sum("n").over(back).alias("events"), (F.sum(F.col("g") + F.col("into").isNotNull().cast("long")).over(back) - F.col("_edge").isNotNull().cast("long")).alias("gaps"),
        (F.sum(F.col("g1") + into).over(back) - F.coalesce("_edge", F.lit(0.0))).alias("_s1"), (F.sum(F.col("g2") + into * into).over(back) - F.coalesce(F.col("_edge") * F.col("_edge"), F.lit(0.0))).alias("_s2"),
        ((F.max("last_us").over(back) - F.min("first_us").over(back)) / 1e6).alias("span"),
    )
    mean = F.when(F.col("gaps") > 0, F.col("_s1") / F.col("gaps"))
    out = out.withColumn("mean_gap", mean).withColumn("_var", F.when(F.col("gaps") > 0, F.greatest(F.col("_s2") / F.col("gaps") - F.col("mean_gap") * F.col("mean_gap"), F.lit(0.0))))
    out = out.withColumn("cv", F.when(F.col("mean_gap") > 0, F.sqrt("_var") / F.col("mean_gap")).otherwise(1e9))
    return out.withColumn("rate", F.when(F.col("span") > 0, F.col("events") / F.col("span")).otherwise(0.0)).drop("_s1", "_s2", "_var")


def host_volume(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.col("src").alias("host"), "bucket").agg(
        F.sum("fwd_bytes").cast("long").alias("bytes_out"), F.sum("bwd_bytes").cast("long").alias("bytes_in"), F.count_distinct("dst").alias("destinations"), F.count("*").alias("out_flows")
    )


def source_mix(flows: DataFrame) -> DataFrame:
    """Per bucket: Shannon entropy of sources in bits, its maximum, sources, and the busiest with its share."""
    counts = flows.groupBy("bucket", "src").agg(F.sum("n_packets").alias("n"))
    total = counts.groupBy("bucket").agg(
        F.sum("n").alias("packets"),
        F.count("*").alias("sources"),
        F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
        F.max(F.struct("n", "src")).alias("_top"),
    )
    entropy = F.log2("packets") - F.col("_nlogn") / F.col("packets")
    return total.select(
        "bucket",
        "packets",
        "sources",
        F.greatest(entropy, F.lit(0.0)).alias("entropy_bits"),
        F.log2("sources").alias("max_entropy_bits"),
        F.col("_top.src").alias("top_source"),
        (F.col("_top.n") / F.col("packets")).alias("top_share"),
    )


def interval_stats(series: DataFrame, starts: str = "starts") -> DataFrame:
    """Regularity of start times: events, positive gaps, mean gap, population deviation over mean, span, rate."""
    us = F.array_sort(F.col(starts))
    n = F.size(us)
    gaps = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: (F.get(us, i - 1) - F.get(us, i - 2)) / 1e6), lambda g: g > 0)
    out = series.withColumn("_g", gaps).withColumn("events", n.cast("long")).withColumn("gaps", F.size("_g").cast("long"))
    mean = F.aggregate("_g", F.lit(0.0), lambda a, g: a + g) / F.col("gaps")
    out = out.withColumn("mean_gap", F.when(F.col("gaps") > 0, mean))
    var = F.aggregate("_g", F.lit(0.0), lambda a, g: a + (g - F.col("mean_gap")) * (g - F.col("mean_gap"))) / F.col("gaps")
    span = (F.element_at(us, -1) - F.get(us, F.lit(0))) / 1e6
    return out.withColumn("cv", F.when(F.col("mean_gap") > 0, F.sqrt(var) / F.col("mean_gap")).otherwise(1e9)).withColumn("span", F.coalesce(span, F.lit(0.0))).withColumn("rate", F.when(F.col("span") > 0, F.col("events") / F.col("span")).otherwise(0.0)).drop("_g")


def name_features(name: Column) -> dict[str, Column]:
    """Registrable domain, length, labels, longest label, entropy in bits and digit share of a DNS-like name."""
    labels = F.split(name, r"\.")
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    size = F.greatest(F.length(name), F.lit(1))

    def term(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / size
        return p * F.log2(p)

    entropy = -F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda a, x: a + x)
    return {
        "registrable": F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(name),
        "qlen": F.length(name).cast("long"),
        "n_labels": F.size(labels).cast("long"),
        "max_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("long"),
        "entropy": F.when(F.length(name) > 0, entropy).otherwise(0.0),
        "digit_ratio": F.length(F.regexp_replace(name, "[^0-9]", "")) / size,
    }


def names_by_domain(queries: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``queries``: ``seq, src, qname, qtype`` and the name features. One row a registrable domain (and ``keys``)."""
    return queries.groupBy(*keys, "registrable").agg(
        F.count("*").alias("queries"),
        F.count_distinct("qname").alias("unique_names"),
        F.avg("entropy").alias("mean_entropy"),
        F.avg("qlen").alias("mean_length"),
        F.max("max_label").alias("max_label"),
        (F.count_if(F.col("qtype") == 16) / F.count("*")).alias("txt_ratio"),
        F.avg("digit_ratio").alias("digit_ratio"),
        F.min_by("src", "seq").alias("first_src"),
    )


def sessions_by_source(sessions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``sessions``: ``src, dst_port, fingerprint`` (null: unavailable), by source (and ``keys``). The ports are the eight least."""
    return sessions.groupBy(*keys, "src").agg(
        F.count("*").alias("sessions"),
        F.count_distinct(F.coalesce("fingerprint", F.lit("fingerprint_unavailable"))).alias("unique_fingerprints"),
        F.count_distinct("fingerprint").alias("available"),
        F.slice(F.array_sort(F.collect_set("dst_port")), 1, 8).alias("dst_ports"),
    )
