"""The alerting service: closed flows, DNS queries and TLS sessions in, fused alerts and the dashboard document out.

Micro-batches are no unit of meaning here. A batch only stages its rows by bucket of event time in the
shared folder; what is scored is a bucket that the watermark has passed, whole, by the same operators as
a table. So a stream gives what the batch operators give on all its rows, however they arrive.

State that outlives a bucket lies beside: rows that pairs may look back on (``pair_ttl_s``), the last
emission of classes with a cooldown, and how often a class led an entity; each ends when event time has
passed it by its time. Every batch writes under its number and reads what the number before wrote, so a
batch that is run again replaces itself. Rows of a bucket that is closed are late and dropped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowloom.functions.packets import is_group_address
from flowloom.operators import aggregates as A
from flowloom.operators import detectors as D
from flowloom.operators import document
from flowloom.operators.folds import cooldown_step, ordered_fold
from flowloom.operators.ranks import with_rank


@dataclass(frozen=True)
class Timing:
    """Seconds: width of a bucket, delay of the watermark, memory of pairs and of persistence, pause after an emission, span of the document."""

    width_s: float = 10.0
    delay_s: float = 10.0
    pair_ttl_s: float = 900.0
    persistence_ttl_s: float = 900.0
    cooldown_s: float = 60.0
    document_s: float = 86_400.0


#: Classes that pause after an emission.
COOLED = ("C2", "DDOS")


def inputs(flows: DataFrame, names: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """One table or stream ``kind, ts, flow, dns, tls`` of its parts.

    ``flows`` as in ``aggregates`` (timed by their end), ``names``: ``seq, ts, src, qname, qtype``, ``sessions``: ``ts, src,
    dst_port, fingerprint``; ``ts`` in seconds.
    """
    parts = {"flow": (flows, F.col("end_us") / 1e6), "dns": (names, F.col("ts")), "tls": (sessions, F.col("ts"))}
    # The service deals rows to buckets itself.
    parts = {k: (df if df is None else df.drop("bucket", "slot"), ts) for k, (df, ts) in parts.items()}
    kinds = {k: df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType for k, (df, _) in parts.items() if df is not None}
    out = None
    for kind, (df, ts) in parts.items():
        if df is None:
            continue
        own = df.select(F.lit(kind).alias("kind"), ts.cast("double").alias("ts"), *[(F.struct(*df.columns) if k == kind else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()])
        out = own if out is None else out.union(own)
    return out


def ddos_groups(flows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Flows that a model scores (``p``) at ``threshold`` or more, by source, subtype and bucket: one result each."""
    hit = flows.where(F.col("p") >= threshold).withColumn("subtype", D.ddos_subtype())
    size = F.col("fwd_bytes") + F.col("bwd_bytes")
    return hit.groupBy("src", "subtype", "bucket").agg(
        F.count("*").alias("aggregated_flows"), F.max("p").alias("max_p"), F.avg("p").alias("mean_p"), F.sum("n_packets").alias("aggregated_packets"), F.sum(size).cast("long").alias("aggregated_bytes"),
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max(F.col("end_us") - F.col("start_us")).alias("span_us"),
    )


def ddos_results(flows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``ddos_groups`` as detector results, with the mix of sources of their bucket."""
    mix = A.source_mix(flows).select(F.col("bucket").alias("_b"), F.to_json(F.struct("sources", "entropy_bits", "max_entropy_bits", "top_source", "top_share")).alias("source_mix"))
    groups = ddos_groups(flows, threshold)
    groups = groups.join(mix, groups["bucket"] == F.col("_b"), "left")
    facts = F.to_json(F.struct("aggregated_flows", F.round("max_p", 4).alias("attack_probability"), F.round("mean_p", 4).alias("mean_attack_probability"), "aggregated_packets", "aggregated_bytes", (F.col("start_us") / 1e6).alias("window_start"), (F.col("end_us") / 1e6).alias("window_end"), (F.col("span_us") / 1e6).alias("window_span_sec"), "source_mix"))
    return groups.select(F.lit("DDOS").alias("threat_class"), F.col("src").alias("entity"), "bucket", F.col("max_p").alias("score"), F.col("max_p").alias("confidence"), "subtype", facts.alias("evidence"), F.lit(True).alias("active"))


def bucket_results(rows: DataFrame, first: int, timing: Timing, detectors: dict | None = None, model: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Detector results of the buckets from slot ``first`` on, and the detectors' status.

    ``rows``: output of ``inputs`` with ``slot``; slots before ``first`` are what pairs look back on. ``model`` adds the
    probability ``p`` to flows.
    """
    rows = rows.withColumn("bucket", F.col("slot") * F.lit(timing.width_s))
    found: dict[str, DataFrame] = {}
    now = F.col("slot") >= first
    if "flow" in rows.columns:
        flows = rows.where("kind = 'flow'").select("flow.*", "slot", "bucket")
        ready = flows.where(now)
        found["recon"], found["exfil"] = A.source_fanout(ready), A.host_volume(ready)
        pairs = A.rolling_pairs(flows.where(~is_group_address(F.col("dst"))), timing.width_s, timing.pair_ttl_s)
        found["c2_beacon"] = pairs.where(F.col("bucket") >= first * timing.width_s)
        if model is not None:
            found["ddos_model"] = model(ready)
    if "dns" in rows.columns:
        names = rows.where(now & (F.col("kind") == "dns")).select("dns.*", "bucket")
        found["dns_names"] = A.names_by_domain(names.withColumns(A.name_features(F.col("qname"))), ("bucket",))
    if "tls" in rows.columns:
        found["handshake_repetition"] = A.sessions_by_source(rows.where(now & (F.col("kind") == "tls")).select("tls.*", "bucket"), ("bucket",))
    return D.run_detectors(found, {**D.REGISTRY, "ddos_model": ddos_results} | (detectors or {}))


class Service:
    """Scores staged buckets; ``each`` is the batch function of a stream, ``flush`` ends it."""

    def __init__(self, folder: str, timing: Timing = Timing(), mode: str = "LIVE", detectors: dict | None = None, model: Callable[[DataFrame], DataFrame] | None = None, sidecar: Callable[[], DataFrame] | None = None) -> None:
        self.folder, self.timing, self.mode = folder.rstrip("/"), timing, mode
        self.detectors, self.model, self.sidecar = detectors, model, sidecar
        self.status: dict[str, str] = {}

    def _file(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def mark(self, spark: SparkSession, number: int) -> dict:
        """What batch ``number`` left: the first open slot, the newest event, and the highest slot of each staged batch."""
        fs, path = self._file(spark, f"marks/{number}.json")
        if number < 0 or not fs.exists(path):
            return {"open": None, "newest": None, "staged": {}}
        return json.loads(spark.read.text(str(path.toString()), wholetext=True).first()[0])

    def _put_mark(self, spark: SparkSession, number: int, mark: dict) -> None:
        fs, path = self._file(spark, f"marks/{number}.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()

    def _delete(self, spark: SparkSession, *names: str) -> None:
        for name in names:
            fs, path = self._file(spark, name)
            fs.delete(path, True)

    def each(self, batch: DataFrame, number: int, last: bool = False) -> None:
        spark, t = batch.sparkSession, self.timing
        mark = self.mark(spark, number - 1)
        rows = batch.withColumn("slot", F.floor(F.col("ts") / t.width_s))
        rows = rows if mark["open"] is None else rows.where(F.col("slot") >= mark["open"])
        # A slot's rows go to as many files as their size asks for, not to one a task.
        rows.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/staged/batch={number}")
        staged = spark.read.schema(rows.schema).option("basePath", f"{self.folder}/staged/batch={number}").parquet(f"{self.folder}/staged/batch={number}")
        seen = staged.agg(F.min("slot").alias("low"), F.max("slot").alias("top"), F.max("ts").alias("newest")).first()
        held = {int(k): v for k, v in mark["staged"].items()}
        first, newest = mark["open"], mark["newest"]
        if seen["top"] is not None:
            held[number] = seen["top"]
            first = seen["low"] if first is None else first
            newest = max(seen["newest"], newest or -math.inf)
        if newest is not None:
            end = max(held.values(), default=first) + 1 if last else math.floor((newest - t.delay_s) / t.width_s)
            if end > first:
                self._score(spark, rows.schema, number, sorted(held), first, end)
                first = end
        # Rows that no pair will look back on go, and with them their batch.
        gone = [k for k, top in held.items() if first is not None and top < first - math.ceil(t.pair_ttl_s / t.width_s)]
        self._put_mark(spark, number, {"open": first, "newest": newest, "staged": {k: v for k, v in held.items() if k not in gone}})
        self._delete(spark, *[f"staged/batch={k}" for k in gone], f"marks/{number - 3}.json")

    def flush(self, spark: SparkSession, schema) -> None:
        """Scores every bucket that is still open: the stream has ended."""
        fs, path = self._file(spark, "marks")
        if fs.exists(path):
            number = max(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path))
            self.each(spark.createDataFrame([], schema), number + 1, last=True)

    def _state(self, spark: SparkSession, number: int, name: str, schema: str) -> DataFrame:
        """What the latest batch before ``number`` that scored a bucket kept."""
        fs, path = self._file(spark, "state")
        done = [k for k in (int(f.getPath().getName()) for f in fs.listStatus(path)) if k < number] if fs.exists(path) else []
        return spark.read.schema(schema).parquet(f"{self.folder}/state/{max(done)}/{name}") if done else spark.createDataFrame([], schema)

    def _score(self, spark: SparkSession, schema, number: int, batches: list[int], first: int, end: int) -> None:
        t = self.timing
        back = math.ceil(t.pair_ttl_s / t.width_s)
        staged = spark.read.schema(schema).option("basePath", f"{self.folder}/staged").parquet(*[f"{self.folder}/staged/batch={k}" for k in batches])
        rows = staged.where((F.col("slot") >= first - back) & (F.col("slot") < end)).drop("batch")
        results, self.status = bucket_results(rows, first, t, self.detectors, self.model)
        if results is None:
            return

        def save(df: DataFrame, name: str) -> DataFrame:
            """Results are few; written once, they are not computed again for each of their uses."""
            path = f"{self.folder}/state/{number}/{name}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        results = save(results.where("active").withColumn("_end", F.col("bucket") + t.width_s).withColumn("_seed", F.lit(False)).coalesce(8), "results")
        # Pauses: the last emission of each key leads its row of results.
        cool = self._state(spark, number, "cooldown", "threat_class string, entity string, subtype string, _end double")
        seeds = cool.select(*[F.col(c) if c in cool.columns else F.lit(True).alias(c) if c == "_seed" else F.lit(None).cast(dict(results.dtypes)[c]).alias(c) for c in results.columns])
        cooled = F.col("threat_class").isin(*COOLED)
        folded = ordered_fold(results.where(cooled).union(seeds), ["threat_class", "entity", "subtype"], ["_end"], ["_end"], "_emit", cooldown_step(t.cooldown_s))
        folded = save(folded, "folded").where("_emit = 1")
        passed = results.where(~cooled).union(folded.where("not _seed").drop("_emit")).drop("_end", "_seed")
        until = end * t.width_s
        keep = folded.groupBy("threat_class", "entity", "subtype").agg(F.max("_end").alias("_end")).where(F.col("_end") > until - t.cooldown_s)
        save(keep, "cooldown")
        led = "threat_class string, entity string, repeats long, last double"
        before = self._state(spark, number, "fusion", led)
        # A class of detectors that alerts by itself is not fused; its risk is its score.
        fused = D.fuse(passed.where("threat_class <> 'DDOS'"), "bucket", before=before)
        fused = save(fused.unionByName(D.fuse(passed.where("threat_class = 'DDOS'"), required=1 << 30)), "fused")
        flows = rows.where((F.col("kind") == "flow") & (F.col("slot") >= first)).select("flow.*", (F.col("slot") * F.lit(t.width_s)).alias("bucket"))
        for name, kind in (("src_port", "int"), ("dst_port", "int"), ("proto", "int")):
            if name not in flows.columns:
                flows = flows.withColumn(name, F.lit(None).cast(kind))
        alerts = D.to_alerts(fused.withColumn("entity", F.col("entity").cast("string")), t.width_s, self.mode, flows.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string")))
        out = alerts.withColumn("repeats", F.get_json_object(F.col("evidence")["_fusion"], "$.persistence_windows").cast("long")).withColumn("entity", F.col("source_ip")).withColumn("day", F.floor(F.col("bucket") / 86_400))
        out.drop("entity").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/alerts/batch={number}")
        new = fused.where("threat_class <> 'DDOS'").groupBy("threat_class", "entity").agg(F.max("repeats").cast("long").alias("repeats"), F.max("bucket").alias("last"))
        both = before.union(new.select("threat_class", "entity", "repeats", "last")).groupBy("threat_class", "entity").agg(F.max("repeats").alias("repeats"), F.max("last").alias("last"))
        save(both.where(F.col("last") >= until - t.persistence_ttl_s), "fusion")
        fs, path = self._file(spark, "state")
        old = sorted(k for k in (int(f.getPath().getName()) for f in fs.listStatus(path)) if k < number)[:-1]
        self._delete(spark, *[f"state/{k}" for k in old])
        self._document(spark, until)

    def alerts(self, spark: SparkSession) -> DataFrame:
        """All alerts so far; folders of other days are not read where ``day`` is filtered."""
        fs, path = self._file(spark, "alerts")
        nothing = D.to_alerts(D.fuse(spark.createDataFrame([], "threat_class string, entity string, bucket double, score double, confidence double, subtype string, active boolean")), self.timing.width_s)
        schema = nothing.withColumn("repeats", F.lit(None).cast("long")).withColumn("day", F.lit(None).cast("long")).withColumn("batch", F.lit(None).cast("int")).schema
        if not fs.exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.folder}/alerts").parquet(f"{self.folder}/alerts")

    def _document(self, spark: SparkSession, until: float) -> None:
        since = until - self.timing.document_s
        recent = self.alerts(spark).where((F.col("day") >= math.floor(since / 86_400)) & (F.col("bucket") >= since))
        rows = with_rank(recent.select((F.col("bucket") + self.timing.width_s).alias("ts"), "event_id", "risk", "threat_class", "subtype", F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"), "stage", "technique", F.lit(None).cast("double").alias("pps")), ["ts", "event_id"], "seq")
        document.write_document(document.document(rows, self.mode, sidecar=self.sidecar() if self.sidecar else None), f"{self.folder}/data.json")


def serve(rows: DataFrame, service: Service, **trigger) -> StreamingQuery:
    """Starts the service on a stream of ``inputs``; by default it takes what is there and ends."""
    return rows.writeStream.option("checkpointLocation", f"{service.folder}/checkpoint").foreachBatch(lambda df, k: service.each(df, k)).trigger(**(trigger or {"availableNow": True})).start()


class Throughput(StreamingQueryListener):
    """Rows, batches and batch durations of streaming queries, as nearest-rank percentiles."""

    def __init__(self, most: int = 20_000) -> None:
        self.rows = self.batches = 0
        self.durations: list[int] = []
        self.most = most

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.durations = [*self.durations, event.progress.batchDuration][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def snapshot(self) -> dict[str, float]:
        d = sorted(self.durations)
        return {"rows": self.rows, "batches": self.batches} | {f"p{round(100 * p)}_ms": d[round(p * (len(d) - 1))] for p in (0.5, 0.95, 0.99) if d}
