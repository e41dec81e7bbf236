"""Threat scores as expressions over aggregates, risk fusion and alerts.

Every detector is a function from an aggregate to the same columns ``threat_class, entity, bucket, score,
confidence, subtype, evidence, active``, so results are united by name. ``REGISTRY`` lists them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUSPICIOUS, ATTACK = 0.5, 0.8
#: Technique ids of threat classes, the statuses of an incident and those each may move to.
TECHNIQUES = {"DDOS": "T1498", "C2": "T1071", "DGA": "T1568", "ENCRYPTED_MALWARE": "T1573", "RECON": "T1046", "EXFIL": "T1041"}
TRANSITIONS = {
    "NEW": ("TRIAGING",),
    "TRIAGING": ("ACKNOWLEDGED", "CONTAINED", "CLOSED"),
    "ACKNOWLEDGED": ("CONTAINED", "CLOSED"),
    "CONTAINED": ("CLOSED",),
    "CLOSED": (),
}
RESULT = ("threat_class", "entity", "bucket", "score", "confidence", "subtype", "evidence", "active")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _result(df: DataFrame, kind: str, entity: str, score: Column, subtype: Column, bucket: Column, evidence: list[str | Column]) -> DataFrame:
    facts = F.to_json(F.struct(*evidence))
    out = df.withColumn("score", clamp01(score)).select(F.lit(kind).alias("threat_class"), F.col(entity).alias("entity"), bucket.alias("bucket"), "score", F.col("score").alias("confidence"), subtype.alias("subtype"), facts.alias("evidence"))
    return out.withColumn("active", F.col("score") >= SUSPICIOUS)


def _bucket(df: DataFrame) -> Column:
    """The bucket of aggregates that have one, else 0."""
    return F.col("bucket") if "bucket" in df.columns else F.lit(0.0)


def beacon_score(min_events: int = 6, strong: float = 0.35, weak: float = 0.65) -> Column:
    cv = F.when(F.col("cv") <= strong, 1.0).when(F.col("cv") < weak, (weak - F.col("cv")) / (weak - strong)).otherwise(0.0)
    return 0.7 * cv + 0.3 * F.least(F.lit(1.0), F.col("events") / (2.0 * min_events))


def c2_beacon(pairs: DataFrame, min_events: int = 6, min_interval_s: float = 1.0, max_rate: float = 0.5) -> DataFrame:
    """``pairs``: output of ``interval_stats`` or ``rolling_pairs``. Low-rate, regular repetition between two hosts."""
    fits = (F.col("events") >= min_events) & (F.col("gaps") >= min_events - 1) & (F.col("mean_gap") >= min_interval_s) & ((F.col("span") <= 0) | (F.col("rate") <= max_rate))
    scored = pairs.where(fits).withColumn("_s", beacon_score(min_events)).where(F.col("_s") >= SUSPICIOUS).withColumn("pair", F.concat_ws("->", "src", "dst"))
    subtype = F.when(F.col("_s") >= ATTACK, "LIKELY_BEACON").otherwise("SUSPICIOUS")
    facts = [F.col("events"), F.col("mean_gap").alias("interval_mean"), F.col("cv").alias("interval_cv"), F.col("rate")]
    return _result(scored, "C2", "pair", F.col("_s"), subtype, _bucket(pairs), facts)


def dga_score(qlen_hi: float = 45) -> Column:
    return clamp01(0.5 * (F.col("mean_entropy") / 4.5) + 0.3 * (F.col("unique_names") / F.greatest(F.col("queries"), F.lit(1))) + 0.2 * F.when(F.col("mean_length") > qlen_hi, 1.0).otherwise(0.0))


def tunnel_score(tunnel_qlen: float = 60, maxlabel_hi: float = 25) -> Column:
    label = F.when(F.col("max_label") >= maxlabel_hi, 1.0).otherwise(F.col("max_label") / maxlabel_hi)
    return clamp01(0.45 * (F.col("mean_length") / tunnel_qlen) + 0.35 * label + 0.2 * F.col("txt_ratio"))


def dns_names(domains: DataFrame, min_queries: int = 5) -> DataFrame:
    """Generated domains and tunnels among ``names_by_domain`` rows; the entity is the first source that asked."""
    enough = domains.where(F.col("queries") >= min_queries)
    enough = enough.withColumn("first_src", F.col("first_src").cast("string"))
    facts = ["registrable", "queries", "unique_names", "mean_entropy", "mean_length", "max_label", "txt_ratio"]
    dga = _result(enough, "DGA", "first_src", dga_score(), F.lit("DGA_DOMAIN"), _bucket(domains), facts)
    tunnel = _result(enough, "DGA", "first_src", tunnel_score(), F.lit("DNS_TUNNEL"), _bucket(domains), facts)
    return dga.unionByName(tunnel).where("active")


def handshake_repetition(sources: DataFrame, min_sessions: int = 3) -> DataFrame:
    score = F.when((F.col("available") > 0) & (F.col("unique_fingerprints") == 1) & (F.col("sessions") >= 2 * min_sessions), 0.6).otherwise(0.0)
    return _result(sources.where(F.col("sessions") >= min_sessions), "ENCRYPTED_MALWARE", "src", score, F.lit("TLS_CLIENT_REP"), _bucket(sources), ["sessions", "unique_fingerprints", "dst_ports"])


def dense(fanout: Column, flows: Column, invert: bool = False) -> Column:
    hit = flows >= 5 * F.greatest(fanout, F.lit(1))
    return ~hit if invert else hit


def recon_score(port_fanout: int = 12, host_fanout: int = 8, invert_density_gate: bool = False) -> Column:
    """A dimension counts only if saturated; ``invert_density_gate`` counts it only if not."""
    ports, hosts, flows = F.col("ports"), F.col("hosts"), F.col("flows")
    by_port = F.when(dense(ports, flows, invert_density_gate), ports / (4.0 * port_fanout)).otherwise(0.0)
    by_host = F.when(dense(hosts, flows, invert_density_gate), hosts / (4.0 * host_fanout)).otherwise(0.0)
    syn = F.when((F.col("syn_only") / F.greatest(flows, F.lit(1)) > 0.8) & (ports >= port_fanout), 0.55).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(by_port, by_host, syn))


def recon_subtype(port_fanout: int = 12, host_fanout: int = 8) -> Column:
    return F.when((F.col("ports") >= port_fanout) & (F.col("hosts") <= 2), "PORT_SCAN").when((F.col("hosts") >= host_fanout) & (F.col("ports") <= 4), "HOST_SCAN").otherwise("SERVICE_DISCOVERY")


def recon(fanout: DataFrame, min_flows: int = 10, port_fanout: int = 12, host_fanout: int = 8, **gate) -> DataFrame:
    scored = fanout.where(F.col("flows") >= min_flows).withColumn("_s", recon_score(port_fanout, host_fanout, **gate)).where(F.col("_s") >= SUSPICIOUS)
    return _result(scored, "RECON", "src", F.col("_s"), recon_subtype(port_fanout, host_fanout), F.col("bucket"), ["ports", "hosts", "flows", "syn_only", "rst_seen"])


def exfil(hosts: DataFrame, min_bytes: int = 5_000_000, out_ratio: float = 8.0, min_dst: int = 3) -> DataFrame:
    ratio = F.col("bytes_out") / F.greatest(F.col("bytes_in"), F.lit(1))
    fits = (F.col("bytes_out") >= min_bytes) & (F.col("ratio") >= out_ratio) & (F.col("destinations") >= min_dst)
    score = F.least(F.lit(1.0), 0.5 + 0.5 * F.least(F.col("ratio") / (4 * out_ratio), F.lit(1.0)))
    return _result(hosts.withColumn("ratio", ratio).where(fits), "EXFIL", "host", score, F.lit("OUTBOUND_ASYMMETRY"), F.col("bucket"), ["bytes_out", "bytes_in", F.col("ratio").alias("outbound_ratio"), "destinations", "out_flows"])


def ddos_subtype() -> Column:
    """Of a flow row with ``syn_count, rst_count, proto, flow_packets_s``."""
    pps = F.col("flow_packets_s")
    return F.when((F.col("syn_count") >= 2) & (F.col("rst_count") == 0), "TCP_SYN_FLOOD").when(F.col("rst_count") >= 2, "TCP_RST_FLOOD").when((F.col("proto") == 17) & (pps > 100), "UDP_FLOOD").when(pps > 1000, "VOLUMETRIC").otherwise("DDOS_GENERIC")


def ddos_model(flows: DataFrame, probability: str, threshold: float = 0.5) -> DataFrame:
    """Flows by the probability that a model gives them; rates with at least one packet and a microsecond."""
    seconds = F.greatest(F.col("flow_duration_s"), F.lit(1e-6))
    rates = flows.withColumn("pps", F.greatest(F.col("n_packets"), F.lit(1)) / seconds).withColumn("bps", (F.col("fwd_bytes") + F.col("bwd_bytes")) / seconds)
    return _result(rates, "DDOS", "src", F.col(probability), ddos_subtype(), F.col("bucket"), ["pps", "bps"]).withColumn("active", F.col("score") >= threshold)


def prediction(score: Column) -> Column:
    return F.when(score >= ATTACK, "ATTACK").when(score >= SUSPICIOUS, "SUSPICIOUS").otherwise("BENIGN")


def severity(risk: Column) -> Column:
    """Of an incident."""
    return F.when(risk >= 0.8, "CRIT").when(risk >= 0.6, "HIGH").otherwise("MED")


def event_severity(risk: Column) -> Column:
    return F.when(risk >= 0.8, "CRIT").when(risk >= 0.5, "WARN").otherwise("INFO")


def host_state(risk: Column, high: float = 0.8, suspect: float = 0.5) -> Column:
    """State of a host on the live document; the contract's emitter uses 0.65 and 0.45."""
    return F.when(risk >= high, "high").when(risk >= suspect, "susp").otherwise("norm")


def fuse(results: DataFrame, hosts_flagged: Column | str | None = None, required: int = 2, bonus: float = 0.05, host_bonus: float = 0.02, before: DataFrame | None = None) -> DataFrame:
    """One row an entity and bucket: the highest active score leads, the others follow.

    The persistence of a leading class is the number of buckets so far in which it led the entity; silent
    buckets do not end it. ``before`` (``threat_class, entity, repeats``) counts those of earlier runs.
    ``hosts_flagged``: a number, or "bucket" for the entities' different hosts in the bucket.
    """
    active = results.where("active")
    if "evidence" not in active.columns:
        active = active.withColumn("evidence", F.lit(None).cast("string"))
    rank = Window.partitionBy("entity", "bucket").orderBy(F.desc("score"), "threat_class", "subtype")
    ranked = active.withColumn("rn", F.row_number().over(rank))
    other = F.when(F.col("rn") > 1, F.struct("rn", "threat_class", F.round("score", 4).alias("score")))
    fused = ranked.groupBy("entity", "bucket").agg(
        F.max(F.when(F.col("rn") == 1, F.col("threat_class"))).alias("threat_class"),
        F.max(F.when(F.col("rn") == 1, F.col("subtype"))).alias("subtype"),
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"),
        F.max("confidence").alias("confidence"),
        F.transform(F.array_sort(F.collect_list(other)), lambda x: F.struct(x["threat_class"].alias("threat_class"), x["score"].alias("score"))).alias("secondary"),
        F.array_sort(F.collect_list(F.struct("rn", "threat_class", F.coalesce("evidence", F.lit("{}")).alias("evidence")))).alias("_facts"),
    )
    if isinstance(hosts_flagged, str):
        host = F.split_part("entity", F.lit("->"), F.lit(1))
        hosts = fused.select("bucket", host.alias("h")).distinct().groupBy("bucket").agg(F.count("*").alias("hosts_flagged"))
        fused = fused.join(hosts, "bucket")
    else:
        fused = fused.withColumn("hosts_flagged", F.lit(1) if hosts_flagged is None else hosts_flagged)
    so_far = Window.partitionBy("threat_class", "entity").orderBy("bucket")
    fused = fused.withColumn("repeats", F.row_number().over(so_far))
    if before is not None:
        old = before.select(F.col("threat_class").alias("_class"), F.col("entity").alias("_entity"), F.col("repeats").alias("_old"))
        fused = fused.join(old, (F.col("threat_class") == F.col("_class")) & F.col("entity").eqNullSafe(F.col("_entity")), "left")
        fused = fused.withColumn("repeats", F.col("repeats") + F.coalesce("_old", F.lit(0))).drop("_class", "_entity", "_old")
    repeat = F.when(F.col("repeats") >= required, bonus * (F.col("repeats") - required + 1)).otherwise(0.0)
    many = F.when(F.col("hosts_flagged") > 1, host_bonus * (F.col("hosts_flagged") - 1)).otherwise(0.0)
    # Of a class that has several results the last one, of the least score, is the evidence.
    facts = F.filter("_facts", lambda x: ~F.exists("_facts", lambda y: (y["threat_class"] == x["threat_class"]) & (y["rn"] > x["rn"])))
    own = F.map_from_entries(F.transform(facts, lambda x: F.struct(x["threat_class"], x["evidence"])))
    how = F.to_json(F.struct(F.lit("max score + persistence + hosts").alias("formula"), F.col("repeats").alias("persistence_windows"), "hosts_flagged", F.lit(bonus).alias("persistence_bonus"), F.lit(host_bonus).alias("cross_host_bonus")))
    fused = fused.withColumn("risk", clamp01(F.col("score") + repeat + many))
    return fused.withColumn("evidence", F.map_concat(own, F.create_map(F.lit("_fusion"), how))).drop("_facts")


#: The fields of an alert in their order.
ALERT = [
    "event_id", "timestamp", "flow_id", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "threat_class", "subtype", "prediction",
    "confidence", "risk", "stage", "technique", "observation_window_sec", "evidence", "model", "latency_ms", "state", "secondary",
]


def to_alerts(fused: DataFrame, width_s: float, mode: str = "REPLAY", flows: DataFrame | None = None, model: tuple[str, float] = ("1.0", 0.5)) -> DataFrame:
    """Alert events of fused rows (``ALERT`` and ``bucket``); ids are digests of what identifies them.

    ``flows`` (``src, dst, src_port, dst_port, proto, flow_no, end_us, bucket``): an alert names the entity's latest
    flow in its bucket; an entity without one names itself. The latency is the time since the bucket's end,
    which is no more than the run's own on a live stream.
    """
    end = F.col("bucket") + width_s
    if flows is not None:
        last = F.max_by(F.struct("src", "dst", "src_port", "dst_port", F.col("proto").cast("string").alias("proto"), F.col("flow_no").cast("string").alias("flow_no")), F.struct("end_us", "flow_no"))
        latest = flows.groupBy(F.col("src").alias("_src"), F.col("bucket").alias("_at")).agg(last.alias("_flow"))
        fused = fused.join(latest, (F.col("entity") == F.col("_src")) & (F.col("bucket") == F.col("_at")), "left")
    else:
        fused = fused.withColumn("_flow", F.lit(None).cast("struct<src:string,dst:string,src_port:int,dst_port:int,proto:string,flow_no:string>"))
    f, pair = F.col("_flow"), F.split("entity", "->")
    key = F.concat_ws("|", "threat_class", "entity", F.col("bucket").cast("string"))
    names = {"6": "TCP", "17": "UDP", "1": "ICMP"}
    protocol = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[f["proto"]], f["proto"], F.lit("TCP"))
    latency = F.greatest((F.unix_micros(F.current_timestamp()) / 1e6 - end) * 1000, F.lit(0.0)) if mode == "LIVE" else F.lit(0.0)
    return fused.select(
        F.substring(F.md5(key), 1, 16).alias("event_id"),
        F.date_format(F.timestamp_seconds(end), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.coalesce(f["flow_no"], "entity").alias("flow_id"),
        F.coalesce(f["src"], pair[0]).alias("source_ip"),
        F.coalesce(f["dst"], F.get(pair, F.lit(1)), F.lit("")).alias("destination_ip"),
        F.coalesce(f["src_port"], F.lit(0)).cast("int").alias("source_port"),
        F.coalesce(f["dst_port"], F.lit(0)).cast("int").alias("destination_port"),
        protocol.alias("protocol"),
        "threat_class",
        "subtype",
        prediction(F.col("risk")).alias("prediction"),
        F.round(clamp01(F.col("confidence")), 4).alias("confidence"),
        F.round(F.col("risk"), 4).alias("risk"),
        F.col("threat_class").alias("stage"),
        F.coalesce("subtype", "threat_class").alias("technique"),
        F.lit(width_s).alias("observation_window_sec"),
        "evidence",
        F.struct(F.concat(F.lit("rule-"), F.lower("threat_class")).alias("name"), F.lit(model[0]).alias("version"), F.lit(model[1]).alias("threshold")).alias("model"),
        F.round(latency, 3).alias("latency_ms"),
        F.lit(mode).alias("state"),
        "secondary",
        "bucket",
    )


def valid_alert() -> Column:
    """Whether an alert meets the schema: known class, scores in [0, 1], ports in range, evidence."""

    def unit(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0, 1)

    def port(c: str) -> Column:
        return F.col(c).isNull() | F.col(c).between(0, 65535)

    return F.coalesce(F.col("threat_class").isin(*TECHNIQUES) & unit("confidence") & unit("risk") & port("source_port") & port("destination_port") & (F.size("evidence") > 0), F.lit(False))


def transition_allowed(current: Column, target: Column) -> Column:
    """Incidents only move forward."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[current], target), F.lit(False))


#: Detectors by name: functions from their aggregate to result rows.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"c2_beacon": c2_beacon, "dns_names": dns_names, "handshake_repetition": handshake_repetition, "recon": recon, "exfil": exfil, "ddos_model": ddos_model}


def run_detectors(inputs: dict[str, DataFrame], registry: dict[str, Callable[..., DataFrame]] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Results of all detectors that have an input, united, and the status of each.

    A detector that cannot be planned is degraded and does not stop the others.
    """
    united, status = None, {}
    for name, detector in (registry or REGISTRY).items():
        if name not in inputs:
            status[name] = "idle"
            continue
        try:
            out = detector(inputs[name]).select(*RESULT)
        except Exception as e:  # any failure of one detector is its own
            status[name] = f"degraded: {type(e).__name__}"
            continue
        status[name] = "ok"
        united = out if united is None else united.unionByName(out)
    return united, status
