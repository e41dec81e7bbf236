"""The packet view over an event table, and scalar functions on addresses, ports and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = (1 << k for k in range(8))
TCP, UDP, ICMP = 6, 17, 1


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packet_view(rows: DataFrame) -> DataFrame:
    """Packets from an event table, dealt to three captures: clients talk to three servers over TCP or UDP."""
    k = F.get_json_object("props", "$.k").cast("int")
    user, proto = F.col("user_id"), F.when(F.col("user_id") % 3 == 0, UDP).otherwise(TCP)
    client = F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))
    server = F.concat(F.lit("192.168.1."), (k % 3 + 1).cast("string"))
    cport, sport = (1024 + user % 60000).cast("int"), F.when(k % 3 == 0, 53).when(k % 3 == 1, 80).otherwise(443)
    flags = F.when(proto == UDP, 0)
    for kind, value in (("signup", SYN), ("click", ACK), ("purchase", PSH | ACK), ("error", RST), ("view", FIN | ACK)):
        flags = flags.when(F.col("event_type") == kind, value)
    base = rows.select(
        F.concat(F.lit("cap"), (F.col("event_id") % 3).cast("string")).alias("capture_file"),
        (F.floor(F.col("event_id") / 3) + 1).alias("pkt_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        k.alias("k"),
        proto.alias("proto"),
        F.col("event_type").isin("error", "view").alias("reverse"),
        client.alias("client"),
        server.alias("server"),
        cport.alias("cport"),
        sport.alias("sport_"),
        flags.alias("tcp_flags"),
        F.floor("value").cast("int").alias("payload_len"),
        user.alias("user_id"),
    )

    def way(a: str, b: str) -> Column:
        return F.when(F.col("reverse"), F.col(b)).otherwise(F.col(a))

    return base.select(
        "capture_file",
        "pkt_no",
        "ts_us",
        (F.col("ts_us") / 1e6).alias("ts"),
        "proto",
        way("client", "server").alias("src"),
        way("server", "client").alias("dst"),
        way("cport", "sport_").alias("sport"),
        way("sport_", "cport").alias("dport"),
        "tcp_flags",
        F.when(F.col("proto") == TCP, 1024 + F.col("k") * 16).otherwise(0).alias("win"),
        F.lit(20).alias("ip_hdr_len"),
        F.when(F.col("proto") == TCP, 20).otherwise(8).alias("l4_hdr_len"),
        (54 + F.col("payload_len")).alias("incl_len"),
        "payload_len",
        "user_id",
        "k",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_view(events(spark, sf_dir))


#: The same view as a DuckDB common table expression named ``packets``.
PACKETS_SQL = """packets AS (
  SELECT capture_file, pkt_no, ts_us, ts_us / 1e6 AS ts, proto,
    CASE WHEN reverse THEN server ELSE client END AS src, CASE WHEN reverse THEN client ELSE server END AS dst,
    CASE WHEN reverse THEN svc ELSE cport END AS sport, CASE WHEN reverse THEN cport ELSE svc END AS dport,
    tcp_flags, CASE WHEN proto = 6 THEN 1024 + k * 16 ELSE 0 END AS win, 20 AS ip_hdr_len,
    CASE WHEN proto = 6 THEN 20 ELSE 8 END AS l4_hdr_len, 54 + payload_len AS incl_len, payload_len, user_id, k
  FROM (
    SELECT 'cap' || CAST(event_id % 3 AS VARCHAR) AS capture_file, event_id // 3 + 1 AS pkt_no, epoch_us(ts) AS ts_us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CASE WHEN user_id % 3 = 0 THEN 17 ELSE 6 END AS proto, event_type IN ('error', 'view') AS reverse,
      '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS client,
      '192.168.1.' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 + 1 AS VARCHAR) AS server,
      CAST(1024 + user_id % 60000 AS INTEGER) AS cport,
      CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 WHEN 0 THEN 53 WHEN 1 THEN 80 ELSE 443 END AS svc,
      CASE WHEN user_id % 3 = 0 THEN 0 WHEN event_type = 'signup' THEN 2 WHEN event_type = 'click' THEN 16 WHEN event_type = 'purchase' THEN 24
        WHEN event_type = 'error' THEN 4 WHEN event_type = 'view' THEN 17 END AS tcp_flags,
      CAST(floor(value) AS INTEGER) AS payload_len, user_id
    FROM events)
)"""


def endpoint(ip: str, port: str) -> Column:
    return F.concat_ws(":", F.col(ip), F.col(port).cast("string"))


def with_flow_key(pk: DataFrame) -> DataFrame:
    """``lo, hi``: the two endpoints in order, so that both directions share a key; ``up``: the packet goes lo to hi.

    Flows never cross captures; packets without a ``capture_file`` are one capture.
    """
    if "capture_file" not in pk.columns:
        pk = pk.withColumn("capture_file", F.lit(""))
    a, b = endpoint("src", "sport"), endpoint("dst", "dport")
    return pk.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)).withColumn("up", a <= b)


KEYED_SQL = """keyed AS (
  SELECT *, least(src || ':' || CAST(sport AS VARCHAR), dst || ':' || CAST(dport AS VARCHAR)) AS lo,
    greatest(src || ':' || CAST(sport AS VARCHAR), dst || ':' || CAST(dport AS VARCHAR)) AS hi,
    src || ':' || CAST(sport AS VARCHAR) <= dst || ':' || CAST(dport AS VARCHAR) AS up
  FROM packets
)"""
KEY = ("capture_file", "lo", "hi", "proto")
#: What mirrored copies of a frame share; two endpoints in order, so rows of an identity have one flow key.
IDENTITY = ("src", "sport", "dst", "dport", "ip_total", "ident")


def has_flag(mask: int) -> Column:
    return (F.col("proto") == TCP) & (F.col("tcp_flags").bitwiseAND(mask) != 0)


def safe_ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(0.0)


def is_group_address(ip: Column) -> Column:
    """Multicast (first octet 224 to 239) or broadcast (last octet 255) IPv4 addresses."""
    first, last = F.split(ip, r"\.")[0].try_cast("int"), F.element_at(F.split(ip, r"\."), -1).try_cast("int")
    return F.coalesce(first.between(224, 239) | (last == 255), F.lit(False))


def ip_text(raw: Column) -> Column:
    """Dotted text of four address bytes."""
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(raw, k, 1)), 16, 10) for k in range(1, 5)])


def bucket_of(ts: Column, width: float) -> Column:
    """The start of the tumbling bucket of ``width`` seconds."""
    return F.floor(ts / width) * F.lit(width)
