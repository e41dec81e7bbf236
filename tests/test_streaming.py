"""Streams give what batches give, also over several batches."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import detectors as D
from flowloom.operators.folds import ordered_fold, reanchor_step
from flowloom.streaming import processors, service
from flowloom.streaming.runs import run_available

FLOWS = "src string, dst string, dst_port int, start_us long, end_us long, n_packets long, fwd_bytes double, bwd_bytes double, syn_only boolean, rst_seen boolean, flow_no string"


@pytest.fixture
def folder(spark, tmp_path):
    for part in range(3):
        rows = spark.range(part * 100, part * 100 + 100).selectExpr("id AS event_id", "id % 4 AS user_id", "timestamp_seconds(1000 + id * 7) AS ts", "CAST(id AS DOUBLE) AS value")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_causal_windows_over_batches(spark, folder):
    got = run_available(processors.causal_windows(stream(spark, folder), "user_id", 100_000_000))
    batch = spark.read.parquet(folder).withColumn("ts_us", F.unix_micros("ts"))
    want = ordered_fold(batch, ["user_id"], ["event_id"], ["ts_us"], "win_no", reanchor_step(100_000_000)).select("user_id", "event_id", "win_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cooldowns_over_batches(spark, folder):
    got = run_available(processors.cooldowns(stream(spark, folder), "user_id", 300.0))
    assert got.count() == 300 and 0 < got.where("emitted = 1").count() < 60


def test_pair_series_keep_state(spark, folder):
    rows = stream(spark, folder).withWatermark("ts", "1 hour").select("ts", F.col("user_id").alias("src"), F.lit(1).cast("long").alias("dst"), "event_id", F.unix_micros("ts").alias("ts_us"))
    out = run_available(processors.pair_series_stream(rows, 10, 3_600_000), "update").groupBy("src").agg(F.max("events").alias("e"), F.max("kept").alias("k"))
    assert {(r["e"], r["k"]) for r in out.collect()} == {(75, 10)}


def test_first_of_each(spark, folder):
    out = run_available(processors.first_of_each(stream(spark, folder), "1 hour", ["user_id"]))
    assert out.count() == 4


def scan_and_beacon(seed=0):
    """Flows of a port scan, a beacon, a host that sends much, a multicast beacon and noise; over 700 seconds."""
    import random

    rng = random.Random(seed)
    rows = []

    def flow(src, dst, port, at, size=(100.0, 100.0), syn=False):
        rows.append((src, dst, port, int(at * 1e6), int((at + 0.5) * 1e6), 3, *size, syn, False, f"{len(rows):05d}"))

    for k in range(60):
        flow("scanner", "victim", k, 100 + k * 0.05, syn=True)
    for k in range(22):
        flow("bot", "server", 8443, 20 + 30 * k)
        flow("router", "224.0.0.5", 0, 21 + 30 * k)
    for k in range(30):
        flow("leak", f"out{k % 4}", 443, 301 + k * 0.2, (9e5, 10.0))
        flow("leak", f"out{k % 4}", 443, 331 + k * 0.2, (9e5, 10.0))
    for _ in range(200):
        flow(f"host{rng.randrange(9)}", f"site{rng.randrange(30)}", rng.choice([80, 443]), rng.uniform(0, 700))
    return rows


SHOWN = ["event_id", "threat_class", "subtype", "source_ip", "destination_ip", "flow_id", "risk", "confidence", "repeats", "bucket"]


def test_service_does_not_depend_on_batches(spark, tmp_path):
    """Fan-outs that span batches, beacons over many buckets, persistence and pauses: one batch and several give the same."""
    flows = spark.createDataFrame(scan_and_beacon(), FLOWS).cache()
    timing = service.Timing(20.0, 20.0, 300.0, 300.0, 60.0)
    rows = service.inputs(flows)
    once, often = (service.Service(f"{tmp_path}/{n}", timing, "REPLAY") for n in "ab")
    once.each(rows, 0, last=True)
    # A batch that is run again replaces itself.
    for k, part in ((0, "ts < 330"), (0, "ts < 330"), (1, "ts >= 330")):
        often.each(rows.where(part), k)
    often.flush(spark, rows.schema)
    want, got = (sorted(tuple(r) for r in s.alerts(spark).select(*SHOWN).collect()) for s in (once, often))
    assert got == want
    kinds = {(r[1], r[3]) for r in want}
    assert {("RECON", "scanner"), ("C2", "bot"), ("EXFIL", "leak")} <= kinds and not [k for k in kinds if k[1] == "router"]
    ends = sorted(r[9] for r in want if r[1] == "C2")
    assert all(b - a >= 60 for a, b in zip(ends, ends[1:]))  # the pause of a pair
    assert max(r[8] for r in want if r[3] == "leak") > 1


def test_service_state_ends(spark, tmp_path):
    """Long after a key's last row nothing of it is kept: neither rows, nor pauses, nor persistence."""
    flows = spark.createDataFrame([(f"s{k}", f"d{j}", j, k * 10_000_000, k * 10_000_000 + j, 1, 9e6, 1.0, True, False, f"{k}-{j}") for k in range(30) for j in range(4)], FLOWS)
    s = service.Service(str(tmp_path), service.Timing(10.0, 0.0, 50.0, 50.0, 20.0, 100.0), "REPLAY")
    rows = service.inputs(flows)
    for k in range(3):
        s.each(rows.where((F.col("ts") >= k * 100) & (F.col("ts") < k * 100 + 100)), k)
    assert len(list((tmp_path / "staged").iterdir())) <= 2
    (last,) = [p for p in (tmp_path / "state").iterdir() if int(p.name) == max(int(q.name) for q in (tmp_path / "state").iterdir())]
    assert 0 < spark.read.parquet(f"{last}/fusion").count() <= 6
    assert len(list((tmp_path / "state").iterdir())) <= 2 and len(list((tmp_path / "marks").glob("*.json"))) <= 3
    # Rows of a closed bucket are late.
    before = s.alerts(spark).count()
    s.each(rows.where("ts < 30"), 3)
    s.flush(spark, rows.schema)
    late = s.alerts(spark)
    assert late.where("bucket < 30").count() == 3 and late.count() >= before


def test_service_on_names_sessions_and_a_model(spark, tmp_path):
    flows = spark.createDataFrame(scan_and_beacon(), FLOWS).withColumns({"syn_count": F.lit(3), "rst_count": F.lit(0), "proto": F.lit(6), "flow_packets_s": F.lit(6.0), "flow_duration_s": F.lit(0.5)})
    names = spark.createDataFrame([(k, 200.0 + k / 5, "dns1", f"h{k:02d}x7h2q9k4r1t5v8w2y6.badges4all.com", 16) for k in range(8)], "seq long, ts double, src string, qname string, qtype int")
    tls = spark.createDataFrame([(210.0 + k / 10, "tls1", 443, "f") for k in range(8)], "ts double, src string, dst_port int, fingerprint string")
    s = service.Service(str(tmp_path), service.Timing(), "REPLAY", model=lambda f: f.withColumn("p", F.when(F.col("src") == "scanner", 0.9).otherwise(0.1)))
    rows = service.inputs(flows, names, tls)
    s.each(rows, 0, last=True)
    out = {(r["threat_class"], r["source_ip"]): r for r in s.alerts(spark).collect()}
    assert {("DGA", "dns1"), ("ENCRYPTED_MALWARE", "tls1"), ("DDOS", "scanner"), ("RECON", "scanner")} <= out.keys()
    d = out["DDOS", "scanner"]
    assert d["risk"] == 0.9 and d["destination_ip"] == "victim" and '"aggregated_flows":60' in d["evidence"]["DDOS"] and "source_mix" in d["evidence"]["DDOS"]
    assert "interval_cv" in out["C2", "bot"]["evidence"]["C2"] and out["C2", "bot"]["model"]["name"] == "rule-c2"
    assert s.status == dict.fromkeys(s.status, "ok")


def test_service_and_throughput(spark, tmp_path):
    import json

    rows = [("s", f"h{k % 3}", k, 1000 * k, 2000 * k, 3, 9e6, 10.0, True, False, str(k)) for k in range(1, 31)]
    service.inputs(spark.createDataFrame(rows, FLOWS)).coalesce(1).write.parquet(f"{tmp_path}/in")
    listener = service.Throughput()
    spark.streams.addListener(listener)
    side = spark.createDataFrame([("INC-0001", "CONTAINED", "me")], "inc_id string, status string, analyst string")
    s = service.Service(f"{tmp_path}/out", sidecar=lambda: side)
    rows = stream(spark, f"{tmp_path}/in")
    service.serve(rows, s).awaitTermination()
    s.flush(spark, rows.schema)
    doc = json.loads((tmp_path / "out" / "data.json").read_text())
    assert doc["overview"]["classes"] == "EXFIL" and doc["overview"]["alerts"] == 1
    assert doc["incidents"][0]["status"] == "CONTAINED" and not list((tmp_path / "out").glob("*.part"))
    spark.streams.removeListener(listener)
    assert set(listener.snapshot()) >= {"rows", "batches"}


def test_failing_detectors_are_isolated(spark):
    results, status = D.run_detectors({"recon": spark.range(1), "exfil": spark.createDataFrame([("h", 0.0, 9_000_000, 1, 3, 3)], "host string, bucket double, bytes_out long, bytes_in long, destinations long, out_flows long")})
    assert results.count() == 1
    assert status["recon"].startswith("degraded") and status["exfil"] == "ok" and status["c2_beacon"] == "idle"
