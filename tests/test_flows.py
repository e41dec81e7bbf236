"""Flows, folds and windows on hand-made packets and random traces."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions.packets import KEY, is_group_address, with_flow_key
from flowloom.operators.flows import FEATURES, METADATA, FlowLimits, drop_mirrors, extract, extract_captures, flow_features, read_flow_table, to_float32, window_rows, with_gap_sessions, with_instances, with_intervals, write_flow_table
from flowloom.operators.folds import caps_step, cooldown_step, early_step, mirror_step, ordered_fold, reanchor_step

COLS = "pkt_no long, ts_us long, proto int, src string, dst string, sport int, dport int, tcp_flags int, win int, ip_hdr_len int, l4_hdr_len int, incl_len int, payload_len int"
S = 1_000_000


def packets(spark, rows):
    """``(ts_us, forward, flags, payload)`` of one conversation."""
    out = []
    for k, (ts, fwd, flags, size) in enumerate(rows, 1):
        ends = ("10.0.0.1", "10.0.0.2", 1000, 80) if fwd else ("10.0.0.2", "10.0.0.1", 80, 1000)
        out.append((k, ts, 6, *ends, flags, 100 + k, 20, 20, 54 + size, size))
    return spark.createDataFrame(out, COLS)


def features(spark, rows, limits=FlowLimits()):
    (row,) = flow_features(with_intervals(with_instances(packets(spark, rows), limits), limits)).collect()
    return row.asDict()


def test_there_are_66_features():
    assert len(FEATURES) == len(set(FEATURES)) == 66


def test_one_packet_flow(spark):
    f = features(spark, [(0, True, 2, 10)])
    assert f["n_packets"] == 1 and f["flow_duration_s"] == 0 and f["syn_count"] == 1 and f["init_fwd_win"] == 101
    assert all(f[c] == 0 for c in FEATURES if c.endswith("_std") or "iat" in c or c.startswith(("active", "idle", "bwd", "flow_")))


def test_idle_gap_is_strict(spark):
    f = features(spark, [(0, True, 16, 0), (S, True, 16, 0)])
    assert f["active_max"] == 1.0 and f["idle_max"] == 0
    f = features(spark, [(0, True, 16, 0), (S + 1, True, 16, 0)])
    assert f["active_max"] == 0 and f["idle_max"] == pytest.approx(1.000001)


def test_both_directions(spark):
    f = features(spark, [(0, True, 2, 0), (100, False, 18, 0), (200, True, 24, 46), (500, False, 24, 946)])
    assert (f["fwd_packets"], f["bwd_packets"], f["fwd_bytes"], f["bwd_bytes"]) == (2, 2, 154, 1054)
    assert (f["fwd_psh"], f["bwd_psh"], f["fwd_data_pkts"], f["bwd_data_pkts"]) == (1, 1, 1, 1)
    assert f["fwd_iat_total"] == pytest.approx(2e-4) and f["bwd_iat_total"] == pytest.approx(5e-4)
    assert f["init_bwd_win"] == 102 and f["fwd_win_mean"] == 102 and f["src_ip"] == "10.0.0.1"
    assert f["active_mean"] == pytest.approx(5e-4)
    assert dict(to_float32(flow_features(with_intervals(with_instances(packets(spark, [(0, True, 2, 0)]))))).dtypes)["protocol"] == "float"


def test_gap_of_exactly_the_timeout_splits(spark):
    pk = with_gap_sessions(packets(spark, [(0, True, 2, 0), (S, True, 2, 0), (2 * S - 1, True, 2, 0)]), S)
    assert [r["instance"] for r in pk.orderBy("pkt_no").collect()] == [1, 2, 2]


def sequential(trace, limits):
    """The sequential rule: sweeps look at all keys at every n-th record, caps at every packet."""
    state, out = {}, []
    for no, (key, ts) in enumerate(trace, 1):
        if no % limits.sweep_every == 0:
            for k, s in state.items():
                if s[1] is not None and ts - s[2] >= limits.timeout_us:
                    state[k] = (s[0], None, None, 0)
        number, start, _, n = state.get(key, (0, None, None, 0))
        if start is None:
            number, start, n = number + 1, ts, 0
        n += 1
        out.append(number)
        ended = n >= limits.packet_cap or ts - start >= limits.activity_cap_us
        state[key] = (number, None, None, 0) if ended else (number, start, ts, n)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_instances_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    limits = FlowLimits(S, 50, 300, 6, 7)
    ts, trace = 0, []
    for _ in range(400):
        ts += rng.choice([0, 1, 3, 20, 60])
        trace.append((rng.randrange(5), ts))
    rows = [(k, ts, 6, f"10.0.0.{key}", "10.1.0.1", 1, 2, 16, 1, 20, 20, 60, 0) for k, (key, ts) in enumerate(trace, 1)]
    out = with_instances(spark.createDataFrame(rows, COLS), limits).orderBy("pkt_no").collect()
    assert [r["instance"] for r in out] == sequential(trace, limits)


def run(step, inputs):
    state, out = None, []
    for x in inputs:
        state, value = step(state, x if isinstance(x, tuple) else (x,))
        out.append(value)
    return out


def test_steps():
    assert run(caps_step(2, 100), [(False, 0), (False, 1), (False, 2), (True, 3), (False, 103), (False, 104)]) == [1, 1, 2, 3, 3, 4]
    assert run(reanchor_step(10), [0, 10, 11, 21, 22]) == [1, 1, 2, 2, 3]
    assert run(early_step(10, 50, 1000, 100), [0, 10, 11, 12, 70, 71]) == [1, 1, 0, 0, 2, 2]
    assert run(mirror_step(2), [0, 2, 4, 5, 9]) == [1, 0, 1, 0, 1]
    assert run(cooldown_step(60.0), [100.0, 130.0, 160.0, 219.0, 220.0]) == [1, 0, 1, 0, 1]


def test_windows_nest_and_are_causal(spark):
    rng = random.Random(9)
    ts, rows = 0, []
    for _ in range(300):
        ts += rng.choice([1, 5, 40, 200])
        rows.append((ts, True, 16, 0))
    keyed = with_flow_key(packets(spark, rows)).cache()
    ids = {}
    for w in (10, 30, 50):
        got = ordered_fold(keyed, KEY, ["pkt_no"], ["ts_us"], "w", early_step(w, 150, 10**9, 10**9)).where("w > 0")
        span = got.groupBy("w").agg((F.max("ts_us") - F.min("ts_us")).alias("d")).agg(F.max("d")).first()[0]
        assert span <= w
        ids[w] = {r["pkt_no"] for r in got.collect()}
    cut = ordered_fold(keyed.where("pkt_no <= 200"), KEY, ["pkt_no"], ["ts_us"], "w", early_step(30, 150, 10**9, 10**9)).where("w > 0")
    assert {r["pkt_no"] for r in cut.collect()} == {p for p in ids[30] if p <= 200}
    assert ids[10] and len(ids[10]) <= len(ids[50])


def test_folds_stay_whole_over_batches(spark):
    df = spark.range(20_000).selectExpr("id", "id % 3 AS k", "id AS ts")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    out = ordered_fold(df, ["k"], ["id"], ["ts"], "w", reanchor_step(99))
    assert out.agg(F.max("w")).first()[0] == 197
    assert ordered_fold(df.limit(0), ["k"], ["id"], ["ts"], "w", reanchor_step(9)).count() == 0


def test_group_addresses(spark):
    rows = spark.createDataFrame([("224.0.0.5",), ("10.0.0.255",), ("10.0.0.1",), (None,), ("x",)], "ip string")
    assert [r[0] for r in rows.select(is_group_address(F.col("ip"))).collect()] == [True, True, False, False, False]


def test_captures_stay_apart(spark):
    """The same packets in three captures are three times the flows, not one of all."""
    rows = [(f"c{c}", k, k * 10, 6, *ends, 16, 1, 20, 20, 60, 0) for c in range(3) for k in range(1, 12) for ends in [("10.0.0.1", "10.0.0.2", 1, 2) if k % 2 else ("10.0.0.2", "10.0.0.1", 2, 1)]]
    out = with_instances(spark.createDataFrame(rows, "capture_file string, " + COLS), FlowLimits(S, 50, 300, 6, 4))
    assert out.count() == 33
    by = out.groupBy("capture_file", "instance").count().collect()
    assert sorted((r["capture_file"], r["instance"], r["count"]) for r in by) == [(f"c{c}", i, n) for c in range(3) for i, n in ((1, 6), (2, 5))]


def test_null_keys_are_keys(spark):
    rows = [(None, 5, k, k) for k in range(6)] + [(5, None, k, k) for k in range(6)] + [(None, None, k, k) for k in range(3)]
    df = spark.createDataFrame(rows, "a int, b int, n int, ts long")
    out = ordered_fold(df, ["a", "b"], ["n"], ["ts"], "kept", mirror_step(100))
    assert sorted((str(r["a"]), str(r["b"])) for r in out.where("kept = 1").collect()) == [("5", "None"), ("None", "5"), ("None", "None")]


@pytest.mark.parametrize("seed", range(3))
def test_mirrors_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, ts = [], 0
    for k in range(1, 500):
        ts += rng.choice([0, 0, 1, 2, 3, 9]) - (rng.random() < 0.05) * 4
        rows.append((f"c{k % 2}", k, ts, 6, "a", rng.choice("bc"), 1, 2, rng.randrange(2)))
    df = with_flow_key(spark.createDataFrame(rows, "capture_file string, pkt_no long, ts_us long, proto int, src string, dst string, sport int, dport int, ident int").withColumn("ip_total", F.lit(40)))
    last, want = {}, set()
    for c, k, t, _, _, dst, _, _, ident in rows:
        if (c, dst, ident) not in last or abs(t - last[c, dst, ident]) > 2:
            last[c, dst, ident] = t
            want.add(k)
    assert {r["pkt_no"] for r in drop_mirrors(df, 2).collect()} == want


def written_captures(root):
    """Two captures of a random trace with mirrors, broken frames and one idle end, as files; and the trace."""
    from flowloom.sources import pcap

    traces, rng = {}, random.Random(4)
    for name, family in (("one", "Legitimate Traffic"), ("two", "UDP Flood")):
        ts, frames, trace = 1_700_000_000_000_000, [], []
        for k in range(300):
            ts += rng.choice([1, 1, 40, 900, 2500])
            if k % 23 == 5:
                frames.append((ts, b"broken"))
                trace.append((ts, None))
                continue
            a, b = rng.choice([("10.0.0.1", "10.0.0.2"), ("10.0.0.2", "10.0.0.1"), ("10.0.0.1", "10.0.0.3")])
            proto = rng.choice([6, 17])
            ports = (1000, 80) if a < b else (80, 1000)
            payload = bytes([k % 251]) * rng.randrange(1, 40)
            f = pcap.frame(a, b, proto, *ports, payload, seq=k)
            for copy in range(rng.choice([1, 1, 2, 3])):
                frames.append((ts + copy, pcap.frame(a, b, proto, *ports, payload, seq=k, tags=copy)))
                trace.append((ts + copy, (proto, a, ports[0], b, ports[1], len(f), len(f) + 4 * copy, k)))
            ts += 2
        (root / family).mkdir()
        pcap.write_pcap(str(root / family / f"{name}.pcap"), frames)
        traces[f"{name}.pcap"] = trace
    return traces


def metered(trace, limits):
    """A sequential meter: ``{(flow, start, end, packets, bytes, ended_by)}`` of one capture."""
    flows, out, kept = {}, [], {}

    def end(key, why):
        first, start, last, n, size = flows.pop(key)
        out.append(("|".join(map(str, (first[0], first[1], first[2], first[3], first[4]))), start, last, n, size, why))

    for no, (ts, packet) in enumerate(trace, 1):
        if no % limits.sweep_every == 0:
            for key in [k for k, f in flows.items() if ts - f[2] >= limits.timeout_us]:
                end(key, "timeout")
        if packet is None:
            continue
        identity = (*packet[:6], packet[7])
        if identity in kept and abs(ts - kept[identity]) <= limits.mirror_us:
            continue
        kept[identity] = ts
        proto, a, pa, b, pb, _, size, _ = packet
        key = (proto, *sorted([(a, pa), (b, pb)]))
        first, start, _, n, total = flows.get(key, (packet, ts, ts, 0, 0))
        flows[key] = (first, start, ts, n + 1, total + size)
        if n + 1 >= limits.packet_cap:
            end(key, "packet_cap")
        elif ts - start >= limits.activity_cap_us:
            end(key, "activity_cap")
    for key in list(flows):
        _, start, last, _, _ = flows[key]
        end(key, "timeout" if trace[-1][0] - last >= limits.timeout_us or last - start >= limits.timeout_us else "capture_end")
    return out


@pytest.mark.parametrize("limits", [FlowLimits(500, 3000, 10**9, 10**6, 20), FlowLimits(500, 3000, 20_000, 9, 20)])
def test_flow_table_of_captures(spark, tmp_path, limits):
    (tmp_path / "in").mkdir()
    traces = written_captures(tmp_path / "in")
    flows = extract_captures(spark, str(tmp_path / "in"), limits)
    assert flows.columns == [*METADATA, *FEATURES] and {t for c, t in flows.dtypes if c in FEATURES} == {"float"}
    rows = flows.collect()
    got = sorted((r["capture_file"], r["flow_id"], round(r["start_ts"] * 1e6), round(r["end_ts"] * 1e6), r["n_packets"], r["fwd_bytes"] + r["bwd_bytes"], r["ended_by"]) for r in rows)
    assert got == sorted((name, *f) for name, trace in traces.items() for f in metered(trace, limits))
    assert {(r["capture_file"], r["family"], r["binary_label"]) for r in rows} == {("one.pcap", "benign", "benign"), ("two.pcap", "udp_flood", "attack")}
    write_flow_table(flows, f"{tmp_path}/flows")
    back = read_flow_table(spark, f"{tmp_path}/flows", ["two.pcap"])
    assert back.count() == sum(r["capture_file"] == "two.pcap" for r in rows)
    assert "PartitionFilters: [isnotnull(capture_file" in back._jdf.queryExecution().toString() or "PartitionFilters: [(capture_file" in back._jdf.queryExecution().toString()


def test_window_rows_hold_features(spark):
    rng = random.Random(3)
    ts, rows = 0, []
    for _ in range(200):
        ts += rng.choice([1, 5, 40, 200])
        rows.append((ts, rng.random() < 0.6, 16, rng.randrange(50)))
    limits = FlowLimits(20, 150, 10**9, 10**9)
    pk = packets(spark, rows)
    ids = {}
    for w in (10, 30, 50):
        out = window_rows(pk, w, limits).collect()
        assert all(r["ended_by"] == f"window_{w / 1e6:g}s" and r["_window"] == w / 1e6 and r["n_packets"] >= 1 for r in out)
        assert all(r["end_ts"] - r["start_ts"] <= w / 1e6 + 1e-6 and r["flow_duration_s"] <= w / 1e6 + 1e-6 for r in out)
        frozen = [r["_frozen_at"] for r in sorted(out, key=lambda r: r["instance"])]
        assert all(f > r["start_ts"] + w / 1e6 for f, r in zip(frozen, sorted(out, key=lambda r: r["instance"]), strict=True) if f == f)
        assert sum(f != f for f in frozen) <= 1
        ids[w] = {(r["instance"], r["start_ts"]) for r in out}
    # Rows whose window has closed don't change when what comes later is cut off.
    whole = {r["instance"]: r for r in window_rows(pk, 30, limits).collect()}
    cut = {r["instance"]: r for r in window_rows(pk.where("pkt_no <= 120"), 30, limits).collect()}
    closed = [k for k, r in cut.items() if r["_frozen_at"] == r["_frozen_at"]]
    assert closed and all(cut[k] == whole[k] for k in closed)


def test_extract_of_nothing(spark):
    from flowloom.sources import pcap

    assert extract(spark.createDataFrame([], pcap.SCHEMA)).count() == 0
