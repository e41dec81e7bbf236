"""Seven synthetic scenarios as packet tables, and traffic of any size, from a range and deterministic expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of all scenarios, in microseconds.
START = 1_700_000_000_000_000


def _packets(spark: SparkSession, name: str, n: int, gap_us: int, **cols: Column | int | str) -> DataFrame:
    base = {"src": "10.0.0.5", "dst": "93.184.216.34", "sport": 40000, "dport": 443, "proto": 6, "tcp_flags": 24, "payload_len": 100, "qname": None} | cols
    out = spark.range(n).withColumn("ts_us", F.lit(START) + F.col("id") * gap_us)
    kinds = {"qname": "string", "src": "string", "dst": "string"}
    return out.select(F.lit(name).alias("scenario"), (F.col("id") + 1).alias("pkt_no"), "ts_us", *[(v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(c, "int")).alias(c) for c, v in base.items()])


def scenarios(spark: SparkSession, scale: int = 1) -> DataFrame:
    """benign, c2, dga, tunnel, scan, exfil and tls_rep; ``scale`` multiplies their packets."""
    i = F.col("id")
    label = F.substring(F.sha1(i.cast("string").cast("binary")), 1, 14)
    parts = [
        _packets(spark, "benign", 40 * scale, 700_000, dst=F.concat(F.lit("93.184.216."), (i % 5 + 1).cast("string")), sport=40000 + i % 8, payload_len=200 + i % 300),
        _packets(spark, "c2", 12 * scale, 30_000_000, dst="198.51.100.7", sport=41000 + i % 10000, payload_len=64),
        _packets(spark, "dga", 10 * scale, 2_000_000, dst="10.0.0.53", dport=53, proto=17, tcp_flags=0, payload_len=40, qname=F.concat(label, F.lit(".x7h2q.com"))),
        _packets(spark, "tunnel", 6 * scale, 1_000_000, dst="10.0.0.53", dport=53, proto=17, tcp_flags=0, payload_len=110, qname=F.concat(F.repeat(label, 5), F.lit(".t.example.net"))),
        _packets(spark, "scan", 30 * scale, 50_000, dst="10.0.0.9", sport=50000 + i % 10000, dport=1 + i % 1024, tcp_flags=2, payload_len=0),
        _packets(spark, "exfil", 60 * scale, 100_000, dst=F.concat(F.lit("203.0.113."), (i % 3 + 1).cast("string")), payload_len=1400, sport=42000 + i % 3),
        _packets(spark, "tls_rep", 8 * scale, 5_000_000, dst="203.0.113.77", sport=43000 + i % 10000, payload_len=180),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traffic(spark: SparkSession, packets: int, captures: int = 50, hosts: int = 2000) -> DataFrame:
    """Dissected records of so many captures: hosts that talk to servers in both directions, some mirrored, a few broken."""
    i = F.col("id")
    number, h = F.floor(i / captures) + 1, F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # A third of the frames repeats the one before, a microsecond later.
    of = F.when(number % 3 == 0, number - 1).otherwise(number)
    mixed = F.pmod(F.xxhash64(of, i % captures), F.lit(1 << 30))
    client, server = F.concat(F.lit("10.0."), F.floor(mixed % hosts / 250).cast("string"), F.lit("."), (mixed % hosts % 250).cast("string")), F.concat(F.lit("192.168.1."), (mixed % 40).cast("string"))
    back = F.floor(mixed / 64) % 3 == 0
    proto, size = F.when(mixed % 5 == 0, 17).otherwise(6), (F.floor(mixed / 7) % 1400).cast("int")
    cport, sport = (1024 + mixed % hosts).cast("int"), F.when(mixed % 2 == 0, 443).otherwise(80)

    def way(a: Column, b: Column) -> Column:
        return F.when(back, b).otherwise(a)

    return spark.range(packets).select(
        F.concat(F.lit("cap"), (i % captures).cast("string")).alias("capture_file"), number.alias("pkt_no"), (F.lit(START) + of * 4000 + F.when(number % 3 == 0, 1).otherwise(0)).alias("ts_us"),
        (size + 54).alias("incl_len"), (size + 54).cast("long").alias("orig_len"), F.when(h % 997 == 0, "malformed").otherwise("parsed").alias("status"), F.lit(0).alias("vlan_tags"), proto.alias("proto"),
        way(client, server).alias("src"), way(server, client).alias("dst"), way(cport, sport).cast("int").alias("sport"), way(sport, cport).cast("int").alias("dport"), F.when(proto == 6, (F.lit(1) * (1 << 4) + mixed % 8).cast("int")).otherwise(0).alias("tcp_flags"),
        F.lit(1024).alias("win"), F.lit(20).alias("ip_hdr_len"), F.when(proto == 6, 20).otherwise(8).alias("l4_hdr_len"), (size + 40).alias("ip_total"), size.alias("payload_len"), mixed.cast("string").cast("binary").alias("ident"),
    )
