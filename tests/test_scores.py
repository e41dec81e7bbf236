"""Detectors, fusion, metrics, splits, audits, documents and models on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.operators import aggregates as A
from flowloom.operators import audit, document, metrics, splits
from flowloom.operators import detectors as D
from flowloom.operators.flows import FEATURES


def test_beacons(spark):
    regular, noisy = [int(30e6 * k) for k in range(12)], [0, 3_000_000, 90_000_000, 95_000_000, 400_000_000, 401_000_000, 900_000_000]
    pairs = A.interval_stats(spark.createDataFrame([("a", "b", regular), ("a", "c", noisy), ("a", "d", [0])], "src string, dst string, starts array<long>"))
    (row,) = D.c2_beacon(pairs).collect()
    assert (row["entity"], row["subtype"], row["score"]) == ("a->b", "LIKELY_BEACON", 1.0)


def test_scans_and_exfiltration(spark):
    fan = spark.createDataFrame([("s", 0.0, 1, 30, 300, 30, 0, 30), ("q", 0.0, 1, 1, 5, 0, 0, 5), ("d", 0.0, 1, 40, 900, 0, 0, 250)], "src string, bucket double, hosts long, ports long, attempts long, syn_only long, rst_seen long, flows long")
    got = {r["entity"]: (r["score"], r["subtype"]) for r in D.recon(fan).collect()}
    assert got == {"s": (0.55, "PORT_SCAN"), "d": (pytest.approx(40 / 48), "PORT_SCAN")}
    hosts = spark.createDataFrame([("h", 0.0, 50_000_000, 1000, 3, 9), ("i", 0.0, 100, 0, 9, 9), ("j", 0.0, 50_000_000, 40_000_000, 5, 5)], "host string, bucket double, bytes_out long, bytes_in long, destinations long, out_flows long")
    assert [(r["entity"], r["score"]) for r in D.exfil(hosts).collect()] == [("h", 1.0)]


def test_names_and_handshakes(spark):
    q = spark.createDataFrame([(k, "c", f"{'abcdefghijklmnop'[k:]}{k}q7z.x7h2q.com", 16) for k in range(10)] + [(99, "c", "", 1)], "seq int, src string, qname string, qtype int")
    q = q.withColumns(A.name_features(F.col("qname")))
    (row,) = A.names_by_domain(q.where("qname <> ''")).collect()
    assert (row["registrable"], row["queries"], row["unique_names"], row["txt_ratio"]) == ("x7h2q.com", 10, 10, 1.0)
    assert q.where("qname = ''").first()["entropy"] == 0.0
    assert {r["subtype"] for r in D.dns_names(A.names_by_domain(q)).collect()} == {"DGA_DOMAIN", "DNS_TUNNEL"} - ({"DNS_TUNNEL"} if row["mean_length"] < 25 else set())
    s = spark.createDataFrame([("a", 443, "f")] * 6 + [("b", 443, None)] * 6 + [("c", 443, "g")] * 2, "src string, dst_port int, fingerprint string")
    got = {r["entity"]: (r["score"], r["active"]) for r in D.handshake_repetition(A.sessions_by_source(s)).collect()}
    assert got == {"a": (0.6, True), "b": (0.0, False)}


def test_fusion_persists_over_quiet_buckets(spark):
    rows = [("RECON", "h", 0.0, 0.7, 0.7, "x", True), ("C2", "h", 0.0, 0.6, 0.9, "y", True), ("RECON", "h", 20.0, 0.7, 0.7, "x", True), ("RECON", "h", 30.0, 0.2, 0.2, "x", False)]
    df = spark.createDataFrame(rows, "threat_class string, entity string, bucket double, score double, confidence double, subtype string, active boolean")
    a, b = D.fuse(df).orderBy("bucket").collect()
    assert (a["threat_class"], a["confidence"], a["repeats"], a["risk"]) == ("RECON", 0.9, 1, 0.7)
    assert [tuple(x) for x in a["secondary"]] == [("C2", 0.6)]
    assert b["repeats"] == 2 and b["risk"] == pytest.approx(0.75)
    alerts = D.to_alerts(D.fuse(df), 10.0).orderBy("timestamp").collect()
    assert [x["prediction"] for x in alerts] == ["SUSPICIOUS", "SUSPICIOUS"] and alerts[0]["timestamp"] == "1970-01-01T00:00:10.000Z"


def test_alert_validity_and_transitions(spark):
    cols = "threat_class string, confidence double, risk double, source_port int, destination_port int, evidence map<string,string>"
    good = ("DDOS", 0.5, 0.5, 1, 65535, {"a": "b"})
    rows = [good, ("X", *good[1:]), ("DDOS", float("nan"), *good[2:]), ("DDOS", 0.5, 1.5, *good[3:]), (*good[:3], 70000, 1, {"a": "b"}), (*good[:5], {}), (*good[:5], None), (*good[:3], None, None, {"a": "b"})]
    assert [r[0] for r in spark.createDataFrame(rows, cols).select(D.valid_alert()).collect()] == [True] + [False] * 6 + [True]
    t = spark.createDataFrame([("NEW", "TRIAGING"), ("NEW", "CLOSED"), ("CLOSED", "NEW"), ("TRIAGING", "CLOSED"), ("?", "NEW")], "a string, b string")
    assert [r[0] for r in t.select(D.transition_allowed(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False]


def test_metrics_by_hand(spark):
    rows = [(1, 0.9, 1), (1, 0.8, 1), (0, 0.8, 1), (1, 0.3, 0), (0, 0.1, 0)]
    s = spark.createDataFrame(rows, "y int, p double, pred int")
    c = metrics.confusion(s).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 1, 1) and c["f1"] == pytest.approx(2 / 3)
    m = metrics.average_precision_auc(s).first()
    assert m["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3) and m["roc_auc"] == pytest.approx(4.5 / 6)
    assert metrics.brier(s).first()[0] == pytest.approx((0.01 + 0.04 + 0.64 + 0.49 + 0.01) / 5)
    grid = {r["threshold"]: (r["tp"], r["fp"]) for r in metrics.threshold_grid(s, [0.2, 0.85]).collect()}
    assert grid == {0.2: (3, 1), 0.85: (1, 0)}
    assert metrics.operating_point(s, 0.0).first()[0] == 0.81
    one = metrics.average_precision_auc(s.where("y = 1")).first()
    assert one["roc_auc"] is None
    assert metrics.confusion(s.limit(0)).first()["f1"] == 0.0
    weights = {r["y"]: r["weight"] for r in metrics.class_weights(s).collect()}
    assert weights == {1: pytest.approx(5 / 6), 0: pytest.approx(5 / 4)}


def test_splits(spark):
    caps = spark.createDataFrame([(f"c{k:02d}", "benign" if k % 3 else "udp_flood", float(k), 10, 100) for k in range(45)], "capture string, family string, first_ts double, n_flows long, n_packets long")
    m = splits.chronological_manifest(caps)
    roles = {r["capture"]: (r["track_a_role"], r["track_a_fold"]) for r in m.collect()}
    assert roles["c00"][0] == "train" and roles["c09"] [0] == "val" and roles["c28"] == ("final_test", -1)
    assert all(r["violations"] == 0 for r in splits.verify_manifest(m).collect())
    assert splits.verify_manifest(m.union(m.limit(1))).where("rule = 'capture_listed_twice'").first()["violations"] == 1
    folds = splits.group_folds(spark.createDataFrame([(f"c{k}", k % 2 * 10, (k + 1) % 2 * 10) for k in range(12)], "capture string, n_pos long, n_neg long"), 3)
    assert sorted(folds.values()) == [0] * 4 + [1] * 4 + [2] * 4
    with pytest.raises(ValueError):
        splits.group_folds(spark.createDataFrame([("a", 1, 0)], "capture string, n_pos long, n_neg long"), 2, tries=2)


def test_audits(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, float("nan")), ("c", 3, None)], "g string, k int, v double")
    assert tuple(audit.duplicate_rows(df, ["k", "v"]).first()) == (5, 3, 2)
    assert [tuple(r) for r in audit.cross_group_duplicates(df, "g", ["k", "v"]).collect()] == [("a", "b", 1)]
    profile = {r["column"]: (r["nulls"], r["not_finite"], r["constant"]) for r in audit.column_profile(df, ["k", "v"]).collect()}
    assert profile["v"][:2] == (1, 1) and not profile["k"][2]
    assert audit.validate_schema(df, {"g": "string", "k": "bigint", "x": "int"}, ("g",)) == ["missing column x", "unexpected column v", "column k is int, not bigint", "identifier g is a feature"]
    assert sorted(r["id"] for r in audit.systematic_sample(spark.range(100), ["id"], 20).collect()) == list(range(0, 100, 5))
    drawn = audit.seeded_sample(spark.range(100, numPartitions=3), ["id"], 9)
    assert drawn.count() == 9 and sorted(drawn.collect()) == sorted(audit.seeded_sample(spark.range(100, numPartitions=7), ["id"], 9).collect())


ALERTS = "seq long, ts double, risk double, threat_class string, subtype string, src string, dst string, stage string, technique string, pps double"


def test_documents(spark, tmp_path):
    rows = [(k, 10.0 * k, 0.5 + 0.1 * (k % 5), "C2" if k % 2 else "RECON", "s", f"h{k % 3}", "d", "C2", "t", None) for k in range(60)]
    a = spark.createDataFrame(rows, ALERTS)
    doc = json.loads(document.document(a).first()["document"])
    assert doc["overview"] == {"max_risk": 0.9, "classes": "C2,RECON", "alerts": 60}
    assert len(doc["windows"]) == 60 and len(doc["events"]) == 50 and len(doc["incidents"]) == 6 and len(doc["hosts"]) == 3
    assert "pps" not in doc["windows"][0]
    document.write_document(document.document(a), f"{tmp_path}/data.json")
    assert json.loads((tmp_path / "data.json").read_text()) == doc
    side = spark.createDataFrame([("INC-0001", "CLOSED", "x" * 60)], "inc_id string, status string, analyst string")
    got = {r["inc_id"]: (r["status"], len(r["analyst"])) for r in document.with_analyst_status(document.incident_rollup(a), side).collect()}
    assert got["INC-0001"] == ("CLOSED", 40) and got["INC-0002"] == ("TRIAGING", 0)
    empty = json.loads(document.document(a.limit(0)).first()["document"])
    assert empty["overview"]["alerts"] == 0


def test_coercions(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("-3",)], "v string")
    assert [r[0] for r in rows.select(document.number(F.col("v"), 0.0, 1.0)).collect()] == [1.0, None, None, None, 0.0]
    d = spark.createDataFrame([(75.0,), (0.5,), (0.0,)], "s double")
    assert [r[0] for r in d.select(document.duration_text(F.col("s"))).collect()] == ["75s", "<1s", "-"]


def test_models(spark):
    pytest.importorskip("numpy")
    from flowloom.operators import ml

    rows = spark.range(600).selectExpr("CAST(id % 2 AS INT) AS y", "concat('c', id % 12) AS capture", "CAST(id % 2 AS DOUBLE) * 2 + rand(1) AS a", "rand(2) AS b")
    rows = ml.weighted(rows)
    for kind in ("lr", "rf"):
        out = ml.scored(ml.pipeline(kind, ["a", "b"]).fit(rows), rows)
        assert metrics.confusion(out).first()["f1"] > 0.95
    sigmoid = ml.calibrate(out.select("p", "y"), "sigmoid").transform(out)
    assert sigmoid.where("p_cal < 0 OR p_cal > 1").count() == 0
    iso = ml.calibrate(out.select("p", "y"), "isotonic").transform(out)
    assert metrics.brier(iso.withColumn("p", F.col("p_cal"))).first()[0] < 0.05
    steps = list(ml.staircase())
    assert len(ml.trials(5)) == 5 and [n for n, _ in steps][-1] == "F_protocol_indicator" and sorted(steps[-1][1]) == sorted(FEATURES)
    _, fitted, record = ml.train_and_test(rows.drop("weight"), ["a", "b"], ["c0", "c1", "c2"], numTrees=10)
    assert record["f1"] > 0.95 and record["n"] == 150 and record["flows_a_second"] > 0 and fitted.kind in ("sigmoid", "isotonic")
    lines = spark.createDataFrame([('{"a": 1, "b": "2.5", "z": 0}',), ('{"a": "x", "b": 1}',), ("nothing",), (None,)], "value string")
    assert [(r["a"], r["b"], r["error"]) for r in ml.parse_records(lines, ["a", "b"]).collect()] == [(1.0, 2.5, None), (None, 1.0, "missing or not finite: a"), (None, None, "no JSON record"), (None, None, "no JSON record")]
    bad = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 0.0)], "a double, b double")
    assert ml.invalid_records(bad, ["a", "b"]).count() == 2


def test_ranks_and_running_sums(spark):
    import random

    from flowloom.operators.ranks import with_rank, with_running

    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), k) for k in range(500)]
    out = with_rank(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], slots=7).collect()
    want = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    assert [(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in out) == list(range(1, 501))
    values = rng.sample(range(10_000), 300)
    out = with_running(spark.createDataFrame([(v / 7, v % 5) for v in values], "p double, n int"), "p", {"total": "n"}, slots=9).collect()
    total = 0
    for r in sorted(out, key=lambda r: -r["p"]):
        total += r["n"]
        assert r["total"] == total
    assert with_rank(spark.createDataFrame([], "a int, b int"), ["a"]).count() == 0


def test_rolling_pairs_equal_the_series(spark):
    import random

    rng = random.Random(5)
    rows = []
    for pair in ("x", "y", "z"):
        t = 0.0
        for k in range(60):
            t += rng.choice([0.0, 3.0, 30.0, 30.0, 200.0, 700.0])
            rows.append((pair, "d", int(t * 1e6), f"{k:03d}", float(t // 10 * 10)))
    flows = spark.createDataFrame(rows, "src string, dst string, start_us long, flow_no string, bucket double")
    out = A.rolling_pairs(flows, 10.0, 300.0).collect()
    assert len(out) == len({(r[0], r[4]) for r in rows})
    for r in out:
        own = sorted(s for p, _, s, _, b in rows if p == r["src"] and r["bucket"] - 300 <= b <= r["bucket"])
        (want,) = A.interval_stats(spark.createDataFrame([(own,)], "starts array<long>")).collect() if r["bucket"] % 40 == 0 else (None,)
        assert r["events"] == len(own)
        if want:
            assert r["gaps"] == want["gaps"] and r["span"] == pytest.approx(want["span"]) and r["rate"] == pytest.approx(want["rate"])
            assert r["mean_gap"] == pytest.approx(want["mean_gap"]) and r["cv"] == pytest.approx(want["cv"], abs=1e-6)


def test_alerts_have_all_fields(spark):
    results = spark.createDataFrame([("RECON", "10.0.0.1", 10.0, 0.7, 0.7, "PORT_SCAN", '{"ports":30}', True), ("EXFIL", "10.0.0.1", 10.0, 0.6, 0.9, "X", '{"bytes_out":9}', True), ("C2", "10.0.0.2->10.0.0.9", 10.0, 0.6, 0.6, "S", "{}", True)], "threat_class string, entity string, bucket double, score double, confidence double, subtype string, evidence string, active boolean")
    flows = spark.createDataFrame([("10.0.0.1", "d1", 1, 80, 6, "f1", 11, 10.0), ("10.0.0.1", "d2", 2, 443, 17, "f2", 12, 10.0), ("10.0.0.1", "d3", 3, 1, 6, "f3", 99, 20.0)], "src string, dst string, src_port int, dst_port int, proto int, flow_no string, end_us long, bucket double")
    out = {r["source_ip"]: r for r in D.to_alerts(D.fuse(results, "bucket"), 10.0, flows=flows).collect()}
    a, c = out["10.0.0.1"], out["10.0.0.2"]
    assert list(a.asDict())[:-1] == D.ALERT and len(D.ALERT) == 21
    assert (a["flow_id"], a["destination_ip"], a["source_port"], a["destination_port"], a["protocol"]) == ("f2", "d2", 2, 443, "UDP")
    assert a["risk"] == pytest.approx(0.72) and a["confidence"] == 0.9 and a["evidence"]["RECON"] == '{"ports":30}' and set(a["evidence"]) == {"RECON", "EXFIL", "_fusion"}
    assert [(x["threat_class"], x["score"]) for x in a["secondary"]] == [("EXFIL", 0.6)]
    assert (c["flow_id"], c["destination_ip"], c["source_port"], c["protocol"], c["model"]["name"]) == ("10.0.0.2->10.0.0.9", "10.0.0.9", 0, "TCP", "rule-c2")
    assert D.to_alerts(D.fuse(results), 10.0).where(D.valid_alert()).count() == 2
