"""Flow instances and the 66-feature flow table.

Packets of both directions share a key; flows never cross captures. An instance ends where a sweep
(every ``sweep_every``-th record of its capture) finds the key idle for ``timeout_us``, or after the
packet that reaches the packet or activity cap. All features of an instance come from one aggregation
over columns that windows on the same partitioning prepare, so the packets are dealt by key once.

Mirrors and caps anchor on earlier decisions, which only a fold can follow. Most keys need none: where
no chain of mirrors outlasts the tolerance and no cap can be reached, running windows decide the same.
``extract`` folds the other keys alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.packets import ACK, CWR, ECE, FIN, IDENTITY, KEY, PSH, RST, SYN, TCP, URG, has_flag, safe_ratio, with_flow_key
from flowloom.operators.folds import caps_step, early_step, mirror_step, ordered_fold


@dataclass(frozen=True)
class FlowLimits:
    """Times in microseconds. The defaults are for packet captures."""

    idle_us: int = 1_000_000
    timeout_us: int = 120_000_000
    activity_cap_us: int = 1_800_000_000
    packet_cap: int = 100_000
    sweep_every: int = 200_000
    mirror_us: int = 2


HOUR = 3_600_000_000
#: The same limits scaled to the event table, where gaps are hours.
EVENT_LIMITS = FlowLimits(12 * HOUR, 72 * HOUR, 240 * HOUR, 8, 200)

STATS = ("max", "min", "mean", "std")
#: The feature columns in their order.
FEATURES = [
    "protocol", "flow_duration_s", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
    *[f"{w}_len_{s}" for w in ("fwd", "bwd", "pkt") for s in STATS],
    *[f"flow_iat_{s}" for s in ("mean", "std", "max", "min")],
    *[f"{w}_iat_{s}" for w in ("fwd", "bwd") for s in ("total", "mean", "std", "max", "min")],
    "fwd_psh", "bwd_psh", "fwd_urg", "bwd_urg",
    *[f"{f}_count" for f in ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")],
    "fwd_header_bytes", "bwd_header_bytes", "down_up_ratio", "avg_pkt_size", "avg_fwd_seg", "avg_bwd_seg",
    "init_fwd_win", "init_bwd_win", "fwd_data_pkts", "bwd_data_pkts",
    *[f"{w}_{s}" for w in ("active", "idle") for s in ("mean", "std", "max", "min")],
    "flow_bytes_s", "flow_packets_s", "fwd_win_mean", "bwd_win_mean",
]


def with_sweeps(pk: DataFrame, records: DataFrame, limits: FlowLimits) -> DataFrame:
    """``sweep, sweep_us``: the last sweep of the capture at or before the packet. ``records``: all records of the captures."""
    every = limits.sweep_every
    if "capture_file" not in records.columns:
        records = records.withColumn("capture_file", F.lit(""))
    sweeps = records.where(F.col("pkt_no") % every == 0).select(F.col("capture_file").alias("_capture"), F.col("pkt_no").alias("_sweep"), F.col("ts_us").alias("sweep_us"))
    keyed = with_flow_key(pk).withColumn("sweep", F.col("pkt_no") - F.col("pkt_no") % every)
    return keyed.join(sweeps, F.col("capture_file").eqNullSafe(F.col("_capture")) & (F.col("sweep") == F.col("_sweep")), "left").drop("_capture", "_sweep")


def _split(limits: FlowLimits) -> Column:
    """Whether a sweep between the key's previous packet and this one found the key idle; over rows of ``with_sweeps``.

    The last sweep at or before a packet decides, as time does not go backwards along packet numbers.
    """
    w = Window.partitionBy(*KEY).orderBy("pkt_no")
    prev_no, prev_us = F.lag("pkt_no").over(w), F.lag("ts_us").over(w)
    return F.coalesce((F.col("sweep") > prev_no) & (F.col("sweep_us") - prev_us >= limits.timeout_us), F.lit(False))


def sweep_flags(pk: DataFrame, limits: FlowLimits, records: DataFrame | None = None) -> DataFrame:
    """``split``: whether a sweep ended the key's instance before this packet."""
    return with_sweeps(pk, pk if records is None else records, limits).repartition(*KEY).withColumn("split", _split(limits))


def _may_cap(limits: FlowLimits) -> Column:
    """Whether the key has enough packets, or lasts long enough, for a cap."""
    whole = Window.partitionBy(*KEY)
    return (F.count("*").over(whole) >= limits.packet_cap) | (F.max("ts_us").over(whole) - F.min("ts_us").over(whole) >= limits.activity_cap_us)


def _by_splits() -> Column:
    """Instances where no cap is reached."""
    return 1 + F.sum(F.col("split").cast("long")).over(Window.partitionBy(*KEY).orderBy("pkt_no"))


def _by_caps(flagged: DataFrame, limits: FlowLimits) -> DataFrame:
    return ordered_fold(flagged, KEY, ["pkt_no"], ["split", "ts_us"], "instance", caps_step(limits.packet_cap, limits.activity_cap_us), dealt=True)


def with_instances(pk: DataFrame, limits: FlowLimits = FlowLimits(), records: DataFrame | None = None) -> DataFrame:
    """``instance``: the number of the flow instance within the key, by sweeps and caps. ``records``: all records, if ``pk`` lacks some."""
    flagged = sweep_flags(pk, limits, records).withColumn("_fold", _may_cap(limits))
    plain = flagged.where(~F.col("_fold")).drop("_fold").withColumn("instance", _by_splits())
    return plain.union(_by_caps(flagged.where("_fold").drop("_fold"), limits).select(*plain.columns))


def _mirror_marks(keyed: DataFrame, tolerance: int) -> DataFrame:
    """``_first``: the frame begins a chain of copies; ``_long``: the chain outlasts the tolerance, or time goes back."""
    w = Window.partitionBy(*KEY, *IDENTITY).orderBy("pkt_no")
    gap = F.col("ts_us") - F.lag("ts_us").over(w)
    out = keyed.withColumn("_first", F.coalesce(F.abs(gap) > tolerance, F.lit(True))).withColumn("_back", F.coalesce(gap < 0, F.lit(False)))
    began = F.last(F.when(F.col("_first"), F.col("ts_us")), ignorenulls=True).over(w)
    return out.withColumn("_long", F.col("_back") | (F.abs(F.col("ts_us") - began) > tolerance)).drop("_back")


def _fold_mirrors(keyed: DataFrame, tolerance: int) -> DataFrame:
    out = ordered_fold(keyed, (*KEY, *IDENTITY), ["pkt_no"], ["ts_us"], "_kept", mirror_step(tolerance), dealt=True)
    return out.where("_kept = 1").drop("_kept")


def drop_mirrors(keyed: DataFrame, tolerance: int = 2) -> DataFrame:
    """The frames (``with_flow_key``) that are no copy, within ``tolerance`` microseconds, of the last kept frame of their identity."""
    marked = _mirror_marks(keyed.repartition(*KEY), tolerance)
    marked = marked.withColumn("_fold", F.max("_long").over(Window.partitionBy(*KEY, *IDENTITY)))
    plain = marked.where("_first and not _fold").select(*keyed.columns)
    return plain.union(_fold_mirrors(marked.where("_fold").select(*keyed.columns), tolerance))


#: The columns that a stored flow has besides its features.
METADATA = ["capture_file", "flow_id", "family", "binary_label", "src_ip", "dst_ip", "src_port", "dst_port", "start_ts", "end_ts", "n_packets", "ended_by"]


def _with_metadata(flows: DataFrame, captures: DataFrame | None) -> DataFrame:
    """``captures``: ``capture_file, family, binary_label``, a row a capture."""
    port = [F.col(c).cast("string") for c in ("src_port", "dst_port")]
    out = flows.withColumn("flow_id", F.concat_ws("|", F.col("proto").cast("string"), "src_ip", port[0], "dst_ip", port[1]))
    out = out.withColumn("start_ts", F.col("start_us") / 1e6).withColumn("end_ts", F.col("end_us") / 1e6)
    if captures is None:
        null = F.lit(None).cast("string")
        return out.withColumn("family", null).withColumn("binary_label", null)
    # As many rows as there are captures; the planner broadcasts them where they are few.
    return out.join(captures.select("capture_file", "family", "binary_label"), "capture_file", "left")


def extract(records: DataFrame, captures: DataFrame | None = None, limits: FlowLimits = FlowLimits()) -> DataFrame:
    """The flow table: ``METADATA`` and 66 features of every flow in dissected records of any number of captures.

    ``records`` has the capture source's columns. Packets that are parsed are dealt by flow key once; mirrors,
    sweeps, instances, features follow on that partitioning. Keys that need a fold take it apart from the rest.
    """
    parsed = records.where(F.col("status") == "parsed")
    swept = with_sweeps(parsed, records.select("capture_file", "pkt_no", "ts_us"), limits).repartition(*KEY)
    columns = [c for c in swept.columns if c not in ("payload", "vlan_tags", "orig_len", "status")]
    marked = _mirror_marks(swept.select(*columns), limits.mirror_us).withColumn("_cap", _may_cap(limits))
    marked = marked.withColumn("_fold", F.max(F.col("_long") | F.col("_cap")).over(Window.partitionBy(*KEY)))
    plain = marked.where("_first and not _fold").select(*columns).withColumn("split", _split(limits)).withColumn("instance", _by_splits())
    folded = _fold_mirrors(marked.where("_fold").select(*columns), limits.mirror_us).repartition(*KEY).withColumn("split", _split(limits))
    parts = [flow_features(with_intervals(x, limits)) for x in (plain, _by_caps(folded, limits))]
    flows = ended_by(parts[0].union(parts[1]), records, limits)
    return to_float32(_with_metadata(flows, captures)).select(*METADATA, *FEATURES)


def extract_captures(spark, root: str, limits: FlowLimits = FlowLimits(), fraction: str = "us") -> DataFrame:
    """The flow table of all captures below ``root``, with the family and label that their top directory names."""
    from flowloom.sources import pcap

    pcap.register(spark)
    found = pcap.discover(spark, root).withColumn("capture_file", F.element_at(F.split("path", "/"), -1))
    return extract(spark.read.format("pcap").option("fraction", fraction).load(root), found, limits)


def window_rows(pk: DataFrame, width_us: int, limits: FlowLimits = FlowLimits()) -> DataFrame:
    """One causal window an instance with the features of its packets: ``METADATA`` but the labels, features, ``_frozen_at``, ``_window``.

    ``_frozen_at`` is the time, in seconds, of the packet that froze the window, NaN where the capture ended first.
    """
    step = early_step(width_us, limits.timeout_us, limits.activity_cap_us, limits.packet_cap)
    rows = ordered_fold(with_flow_key(pk), KEY, ["pkt_no"], ["ts_us"], "_win", step)
    # The first packet outside, before the next window starts, is the one that froze it.
    w = Window.partitionBy(*KEY).orderBy("pkt_no")
    rows = rows.withColumn("instance", F.max("_win").over(w))
    frozen = F.min(F.when(F.col("_win") == 0, F.struct("pkt_no", "ts_us"))).over(Window.partitionBy(*KEY, "instance"))["ts_us"] / 1e6
    rows = rows.withColumn("_frozen", frozen).where("_win > 0").drop("_win")
    ended = f"window_{width_us / 1e6:g}s"
    flows = flow_features(with_intervals(rows, limits), extra=[F.first("_frozen").alias("_frozen")])
    flows = _with_metadata(flows, None).withColumn("ended_by", F.lit(ended)).withColumn("_frozen_at", F.coalesce("_frozen", F.lit(float("nan")))).withColumn("_window", F.lit(width_us / 1e6))
    return to_float32(flows).select(*[c for c in METADATA if c not in ("family", "binary_label")], "instance", *FEATURES, "_frozen_at", "_window")


def with_gap_sessions(pk: DataFrame, gap_us: int) -> DataFrame:
    """``instance`` by gaps alone: a gap of at least ``gap_us`` starts a session."""
    w = Window.partitionBy(*KEY).orderBy("pkt_no")
    new = F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w) >= gap_us).cast("long"), F.lit(1))
    return with_flow_key(pk).withColumn("_new", new).withColumn("instance", F.sum("_new").over(w)).drop("_new")


def with_intervals(pk: DataFrame, limits: FlowLimits = FlowLimits(), keys: tuple[str, ...] = (*KEY, "instance")) -> DataFrame:
    """Direction, inter-arrival seconds (overall and by direction) and the lengths of active runs."""
    w = Window.partitionBy(*keys).orderBy("pkt_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = pk.withColumn("fwd", F.col("up") == F.first("up").over(w))
    out = out.withColumn("iat_us", F.col("ts_us") - F.lag("ts_us").over(w))
    for way, same in (("f", F.col("fwd")), ("b", ~F.col("fwd"))):
        last = F.last(F.when(same, F.col("ts_us")), ignorenulls=True).over(before)
        out = out.withColumn(f"iat_{way}", F.when(same, (F.col("ts_us") - last) / 1e6))
    long = F.col("iat_us") > limits.idle_us
    out = out.withColumn("island", F.sum(F.when(long, 1).otherwise(0)).over(w))
    run = Window.partitionBy(*keys, "island")
    length = F.sum(F.when(~long, F.col("iat_us"))).over(run)
    first = F.row_number().over(run.orderBy("pkt_no")) == 1
    return out.withColumn("active", F.when(first & (length > 0), length / 1e6)).withColumn("idle", F.when(long, F.col("iat_us") / 1e6)).withColumn("iat", F.col("iat_us") / 1e6)


def _stats(name: str, x: Column, which: tuple[str, ...]) -> list[Column]:
    by = {"max": F.max(x), "min": F.min(x), "mean": F.avg(x), "std": F.stddev_samp(x)}
    return [F.coalesce(by[s].cast("double"), F.lit(0.0)).alias(f"{name}_{s}") for s in which]


def flow_features(pk: DataFrame, keys: tuple[str, ...] = (*KEY, "instance"), extra: list[Column] | None = None) -> DataFrame:
    """One row an instance: the key, start, end, packets and the 66 features as doubles.

    ``pk`` comes from ``with_intervals``. ``to_float32`` gives the stored form. ``extra``: further aggregates, kept
    under names that begin with an underscore.
    """
    fwd, bwd = F.col("fwd"), ~F.col("fwd")
    size, tcp = F.col("incl_len").cast("double"), F.col("proto") == TCP
    header = F.col("ip_hdr_len") + F.col("l4_hdr_len")

    def total(cond: Column, x: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("double")

    def first_win(cond: Column) -> Column:
        ordered = F.when(cond & tcp, F.struct("pkt_no", "win"))
        return F.coalesce(F.min(ordered)["win"], F.lit(0)).cast("double")

    order4 = ("mean", "std", "max", "min")
    aggs = [
        F.min_by("ts_us", "pkt_no").alias("start_us"),
        F.max_by("ts_us", "pkt_no").alias("end_us"),
        F.count("*").alias("n_packets"),
        F.min_by("src", "pkt_no").alias("src_ip"),
        F.min_by("dst", "pkt_no").alias("dst_ip"),
        F.min_by("sport", "pkt_no").alias("src_port"),
        F.min_by("dport", "pkt_no").alias("dst_port"),
        F.count_if(fwd).cast("double").alias("fwd_packets"),
        F.count_if(bwd).cast("double").alias("bwd_packets"),
        total(fwd, F.col("incl_len")).alias("fwd_bytes"),
        total(bwd, F.col("incl_len")).alias("bwd_bytes"),
        *_stats("fwd_len", F.when(fwd, size), STATS),
        *_stats("bwd_len", F.when(bwd, size), STATS),
        *_stats("pkt_len", size, STATS),
        *_stats("flow_iat", F.col("iat"), order4),
        *_stats("fwd_iat", F.col("iat_f"), order4),
        *_stats("bwd_iat", F.col("iat_b"), order4),
        F.count("iat_f").alias("_nf"),
        F.count("iat_b").alias("_nb"),
        F.max(F.when(fwd, F.struct("pkt_no", "ts_us")))["ts_us"].alias("_last_f"),
        F.max(F.when(bwd, F.struct("pkt_no", "ts_us")))["ts_us"].alias("_last_b"),
        *[F.count_if(has_flag(mask) & way).cast("double").alias(f"{name}_{flag}") for flag, mask in (("psh", PSH), ("urg", URG)) for name, way in (("fwd", fwd), ("bwd", bwd))],
        *[F.count_if(has_flag(mask)).cast("double").alias(f"{name}_count") for name, mask in (("fin", FIN), ("syn", SYN), ("rst", RST), ("psh", PSH), ("ack", ACK), ("urg", URG), ("ece", ECE), ("cwr", CWR))],
        total(fwd, header).alias("fwd_header_bytes"),
        total(bwd, header).alias("bwd_header_bytes"),
        first_win(fwd).alias("init_fwd_win"),
        first_win(bwd).alias("init_bwd_win"),
        F.count_if(fwd & (F.col("payload_len") > 0)).cast("double").alias("fwd_data_pkts"),
        F.count_if(bwd & (F.col("payload_len") > 0)).cast("double").alias("bwd_data_pkts"),
        *_stats("active", F.col("active"), order4),
        *_stats("idle", F.col("idle"), order4),
        F.coalesce(F.avg(F.when(fwd & tcp, F.col("win"))), F.lit(0.0)).alias("fwd_win_mean"),
        F.coalesce(F.avg(F.when(bwd & tcp, F.col("win"))), F.lit(0.0)).alias("bwd_win_mean"),
    ]
    flows = pk.groupBy(*keys).agg(*aggs, *(extra or []))
    more = [c for c in flows.columns if c.startswith("_") and c not in ("_nf", "_nb", "_last_f", "_last_b")]
    packets_, bytes_ = F.col("fwd_packets") + F.col("bwd_packets"), F.col("fwd_bytes") + F.col("bwd_bytes")
    flows = flows.withColumn("flow_duration_s", (F.col("end_us") - F.col("start_us")) / 1e6)
    derived = {
        "protocol": F.col("proto").cast("double"),
        "fwd_iat_total": F.when(F.col("_nf") > 0, (F.col("_last_f") - F.col("start_us")) / 1e6).otherwise(0.0),
        "bwd_iat_total": F.when(F.col("_nb") > 0, (F.col("_last_b") - F.col("start_us")) / 1e6).otherwise(0.0),
        "down_up_ratio": safe_ratio(F.col("bwd_packets"), F.col("fwd_packets")),
        "avg_pkt_size": safe_ratio(bytes_, packets_),
        "avg_fwd_seg": safe_ratio(F.col("fwd_bytes"), F.col("fwd_packets")),
        "avg_bwd_seg": safe_ratio(F.col("bwd_bytes"), F.col("bwd_packets")),
        "flow_bytes_s": safe_ratio(bytes_, F.col("flow_duration_s")),
        "flow_packets_s": safe_ratio(packets_, F.col("flow_duration_s")),
    }
    return flows.withColumns(derived).select(*keys, "src_ip", "dst_ip", "src_port", "dst_port", "start_us", "end_us", "n_packets", *FEATURES, *more)


def to_float32(flows: DataFrame) -> DataFrame:
    """Features as 32-bit floats; what is not finite becomes 0."""
    clean = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).cast("float") for c in FEATURES}
    return flows.withColumns(clean)


def ended_by(flows: DataFrame, records: DataFrame, limits: FlowLimits = FlowLimits()) -> DataFrame:
    """Why each instance ended: a cap, a timeout, or the end of its capture.

    The last sweep is at the capture's last record, parsed or not; what it leaves open is a timeout if it has
    lasted for the timeout, else the capture's end.
    """
    if "capture_file" not in records.columns:
        records = records.withColumn("capture_file", F.lit(""))
    # One row a capture.
    end = records.groupBy(F.col("capture_file").alias("_capture")).agg(F.max_by("ts_us", "pkt_no").alias("_end"))
    last = Window.partitionBy(*KEY).orderBy(F.desc("instance"))
    duration = F.col("end_us") - F.col("start_us")
    open_ = (F.row_number().over(last) == 1) & (F.col("_end") - F.col("end_us") < limits.timeout_us)
    kind = F.when(F.col("n_packets") >= limits.packet_cap, "packet_cap").when(duration >= limits.activity_cap_us, "activity_cap").when(open_ & (duration < limits.timeout_us), "capture_end").otherwise("timeout")
    return flows.join(end, F.col("capture_file").eqNullSafe(F.col("_capture"))).withColumn("ended_by", kind).drop("_end", "_capture")


def write_flow_table(flows: DataFrame, path: str) -> None:
    """The stored flow table: Parquet with zstd, in a folder a capture, which loaders prune by."""
    flows.write.mode("overwrite").option("compression", "zstd").partitionBy("capture_file").parquet(path)


def read_flow_table(spark, path: str, captures: list[str] | None = None) -> DataFrame:
    """The stored flow table, or of it the captures named: other folders are not read."""
    out = spark.read.parquet(path)
    return out if captures is None else out.where(F.col("capture_file").isin(captures))
