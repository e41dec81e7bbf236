"""Captures byte by byte: magics, tags, fragments, broken headers, cut-off tails; and payload parsers."""

import struct

import pytest

from flowloom.sources import pcap, payloads
from flowloom.sources.scenarios import scenarios

T = 1_700_000_000_000_000


@pytest.fixture
def capture(tmp_path):
    dns = b"\x12\x34\x01\x00\x00\x01" + bytes(6) + b"\x04aval\x05x7h2q\x03com\x00\x00\x10\x00\x01"
    hello = b"\x16\x03\x01\x00\x50\x01\x00\x00\x4c\x03\x03" + bytes(32) + b"\x00" + b"\x00\x04\x13\x01\x13\x02" + b"\x01\x00" + b"\x00\x00"
    bad_ihl = bytearray(pcap.frame("1.2.3.4", "5.6.7.8"))
    bad_ihl[14] = 0x41
    fragment = bytearray(pcap.frame("1.2.3.4", "5.6.7.8"))
    fragment[20:22] = b"\x00\x05"
    short_offset = bytearray(pcap.frame("1.2.3.4", "5.6.7.8"))
    short_offset[14 + 20 + 12] = 0x40
    frames = [
        (T, pcap.frame("10.0.0.1", "10.0.0.2", 6, 1000, 443, b"x" * 600, flags=2, window=77)),
        (T + 3, pcap.frame("10.0.0.1", "10.0.0.53", 17, 1001, 53, dns, tags=2)),
        (T + 5, pcap.frame("10.0.0.1", "10.0.0.2", 1, payload=b"ping")),
        (T + 6, pcap.frame("10.0.0.1", "10.0.0.2", 47, payload=b"gre")),
        (T + 7, bytes(12) + b"\x08\x06" + bytes(30)),
        (T + 8, b"short"),
        (T + 9, bytes(bad_ihl)),
        (T + 10, bytes(fragment)),
        (T + 11, bytes(short_offset)),
        (T + 12, pcap.frame("10.0.0.3", "10.0.0.2", 6, 2000, 443, hello)),
    ]
    path = tmp_path / "udp flood" / "a.pcap"
    path.parent.mkdir()
    pcap.write_pcap(str(path), frames)
    return path


def test_capture_source(spark, capture):
    pcap.register(spark)
    df = spark.read.format("pcap").load(str(capture))
    rows = df.orderBy("pkt_no").collect()
    assert [r["status"] for r in rows] == ["parsed"] * 4 + ["non_ip", "malformed", "malformed", "frag", "malformed", "parsed"]
    tcp, udp, icmp, other = rows[:4]
    assert (tcp["src"], tcp["dport"], tcp["tcp_flags"], tcp["win"], tcp["payload_len"], len(tcp["payload"])) == ("10.0.0.1", 443, 2, 77, 600, 512)
    assert udp["vlan_tags"] == 2 and udp["l4_hdr_len"] == 8 and icmp["l4_hdr_len"] == 8 and other["sport"] == 0
    assert rows[1]["ts_us"] == T + 3
    files = spark.read.format("binaryFile").load(str(capture))
    assert [tuple(r) for r in pcap.from_binary(files).orderBy("pkt_no").collect()] == [tuple(r) for r in rows]
    (stats,) = pcap.capture_stats(df).collect()
    assert stats["packets"] == 10 == stats["parsed"] + stats["non_ip"] + stats["malformed"] + stats["frag"]
    (question,) = payloads.dns_queries(df).collect()
    assert (question["qname"], question["registrable"], question["qtype"], question["n_labels"]) == ("aval.x7h2q.com", "x7h2q.com", 16, 3)
    (session,) = payloads.tls_sessions(df).collect()
    assert session["version"] == "3.3" and len(session["fingerprint"]) == 32
    assert payloads.client_hello(b"\x16\x03\x01\x00\x50\x01\x00\x00\x4c\x03\x03") == (None, None)


def test_discovery(spark, capture):
    (row,) = pcap.discover(spark, str(capture.parent.parent)).collect()
    assert (row["family"], row["binary_label"], row["layer"]) == ("udp_flood", "attack", "transport")


@pytest.mark.parametrize("magic", list(pcap.MAGICS))
def test_byte_orders_and_cut_tails(tmp_path, magic):
    path = tmp_path / "x.pcap"
    pcap.write_pcap(str(path), [(T, b"a" * 20), (T + 1, b"b" * 30)], magic)
    whole = path.read_bytes()
    path.write_bytes(whole[:-1])
    with open(path, "rb") as f:
        got = list(pcap.records(f, "magic"))
    assert [(ts, len(x)) for ts, *_, x in got] == [(T, 20)]


def test_unreadable_captures(tmp_path):
    import io

    for raw in (b"\x0a\x0d\x0d\x0a" + bytes(40), b"", b"GIF89a" + bytes(40)):
        with pytest.raises(pcap.CaptureError):
            list(pcap.records(io.BytesIO(raw)))
    huge = b"\xd4\xc3\xb2\xa1" + bytes(20) + struct.pack("<4I", 0, 0, 2**31 + 1, 0)
    with pytest.raises(pcap.CaptureError):
        list(pcap.records(io.BytesIO(huge)))


def test_capture_stream(spark, capture):
    pcap.register(spark)
    rows = spark.readStream.format("pcap").load(str(capture.parent)).select("pkt_no", "status")
    q = rows.writeStream.format("memory").queryName("caps").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("caps").count() == 10


def test_capture_stream_reads_late_names(spark, tmp_path):
    """A file that comes later under a smaller name, or in a folder below, is read too; none is read twice."""
    pcap.register(spark)
    one = [(T, pcap.frame("10.0.0.1", "10.0.0.2"))]
    rows = spark.readStream.format("pcap").load(str(tmp_path / "in"))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for names in (["m.pcap"], ["a.pcap", "z.cap"], ["sub/b.pcap"]):
        for n in names:
            pcap.write_pcap(str(tmp_path / "in" / n), one)
        rows.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("capture_file").collect()) == ["a.pcap", "b.pcap", "m.pcap", "z.cap"]


def test_capture_headers(spark, tmp_path):
    pcap.write_pcap(str(tmp_path / "a.pcap"), [(T, b"a" * 20), (T + 1, b"b" * 30)], b"\xa1\xb2\x3c\x4d")
    (tmp_path / "b.pcap").write_bytes((tmp_path / "a.pcap").read_bytes()[:-1])
    (tmp_path / "c.pcap").write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(40))
    out = {r["path"][-6:]: tuple(r)[1:] for r in pcap.headers(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert out["a.pcap"] == ("big", 10**9, 65535, 1, 2, False, None) and out["b.pcap"][4:6] == (1, True) and out["c.pcap"][-1] == "pcapng"



def test_scenarios(spark):
    counts = {r["scenario"]: r["count"] for r in scenarios(spark, 2).groupBy("scenario").count().collect()}
    assert counts == {"benign": 80, "c2": 24, "dga": 20, "tunnel": 12, "scan": 60, "exfil": 120, "tls_rep": 16}


def test_traffic_makes_flows(spark):
    from flowloom.operators.flows import extract
    from flowloom.sources.scenarios import traffic

    records = traffic(spark, 3000, 5, 20)
    flows = extract(records)
    (r,) = flows.selectExpr("count(DISTINCT capture_file) AS c", "sum(n_packets) AS n", "max(bwd_packets) AS b").collect()
    assert r["c"] == 5 and r["b"] > 0 and 1900 < r["n"] < 2100


def test_sinks(spark, tmp_path):
    from flowloom.sources import sinks

    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert sinks.append_missing(a, f"{tmp_path}/t", "k").count() == 2
    assert sinks.append_missing(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string"), f"{tmp_path}/t", "k") is not None
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        sinks.append_missing(spark.createDataFrame([(9,)], "other int"), f"{tmp_path}/t", "other")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert sinks.read_if_exists(spark, f"{tmp_path}/none", "k int").count() == 0 and sinks.read_if_exists(spark, f"{tmp_path}/t", "k int").count() == 3
    sinks.write_csv(a, f"{tmp_path}/c")
    assert sinks.read_csv(spark, f"{tmp_path}/c", "k int, v string").count() == 2
    sinks.write_json_lines(a, f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").where("value = '{\"k\":2}'").count() == 1
    assert "| 1 | x |" in sinks.markdown(a, "T")


def test_reports(spark, tmp_path):
    from flowloom.functions.text import log_fields, markdown_rows

    p = tmp_path / "r.md"
    p.write_text("# T\n| a | b |\n|---|:-:|\n| 1 | x y |\ntext\n")
    assert [r["cells"] for r in markdown_rows(spark, str(p)).collect()] == [["a", "b"], ["1", "x y"]]
    p.write_text("pkts=1,234 flows=56\nnothing\n")
    (row,) = log_fields(spark, str(p), {"pkts": r"pkts=([\d,]+)", "flows": r"flows=([\d,]+)"}).collect()
    assert (row["pkts"], row["flows"]) == (1234.0, 56.0)


def test_config(tmp_path, monkeypatch):
    from flowloom.config import Config

    p = tmp_path / "c.json"
    p.write_text('{"window_s": 5}')
    monkeypatch.setenv("FLOWLOOM_SEED", "7")
    c = Config.load(str(p))
    assert (c.window_s, c.seed, c.threshold) == (5.0, 7, 0.5)
    p.write_text('{"nope": 5}')
    with pytest.raises(ValueError):
        Config.load(str(p))
