"""Metadata of DNS questions and TLS hellos in payloads, as Python table functions would give: one row or none.

Only the first bytes of a payload are kept by the packet source, so both parsers stop where it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.aggregates import name_features


def dns_question(payload: bytes) -> tuple[str, int] | None:
    """``(name, type)`` of the first question; None without one, or if its name is compressed or cut off."""
    if len(payload) < 20 or not int.from_bytes(payload[4:6], "big"):
        return None
    labels, at = [], 12
    while at < len(payload) and (size := payload[at]):
        if size >= 64 or at + 1 + size > len(payload):
            return None
        labels.append(payload[at + 1 : at + 1 + size].decode("latin-1"))
        at += 1 + size
    if not labels:
        return None
    kind = payload[at + 1 : at + 3]
    return ".".join(labels), int.from_bytes(kind, "big") if len(kind) == 2 else 0


def client_hello(payload: bytes) -> tuple[str | None, str | None] | None:
    """``(version, fingerprint)`` of a TLS client hello; the fingerprint is None if the hello is cut off."""
    if len(payload) < 6 or payload[:2] != b"\x16\x03" or payload[5] != 1:
        return None
    try:
        version = f"{payload[9]}.{payload[10]}"
        at = 44 + payload[43]
        size = int.from_bytes(payload[at : at + 2], "big")
        suites = payload[at + 2 : at + 2 + size]
        at += 2 + size
        at += 1 + payload[at]
        extensions = int.from_bytes(payload[at : at + 2], "big") if at + 2 <= len(payload) else 0
    except IndexError:
        return None, None
    return version, hashlib.md5(f"{version},{suites.hex().upper()},{extensions}".encode()).hexdigest()


def dns_queries(packets: DataFrame) -> DataFrame:
    """``seq, ts_us, src, qname, qtype`` and the name features of DNS questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [dns_question(x or b"") for x in b.column("payload").to_pylist()]
            keep = pa.array([x is not None for x in found], pa.bool_())
            rest = b.filter(keep)
            names = [x for x in found if x]
            yield pa.RecordBatch.from_arrays([rest.column("seq"), rest.column("ts_us"), rest.column("src"), pa.array([n for n, _ in names], pa.string()), pa.array([t for _, t in names], pa.int32())], names=["seq", "ts_us", "src", "qname", "qtype"])

    udp = packets.where((F.col("proto") == 17) & (F.col("dport") == 53)).select(F.col("pkt_no").alias("seq"), "ts_us", "src", "payload")
    return udp.mapInArrow(run, "seq bigint, ts_us bigint, src string, qname string, qtype int").withColumns(name_features(F.col("qname")))


def tls_sessions(packets: DataFrame) -> DataFrame:
    """``seq, ts_us, src, dst_port, version, fingerprint`` of client hellos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [client_hello(x or b"") for x in b.column("payload").to_pylist()]
            rest = b.filter(pa.array([x is not None for x in found], pa.bool_()))
            hellos = [x for x in found if x]
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("seq", "ts_us", "src", "dst_port")), pa.array([v for v, _ in hellos], pa.string()), pa.array([f for _, f in hellos], pa.string())], names=["seq", "ts_us", "src", "dst_port", "version", "fingerprint"])

    tcp = packets.where(F.col("proto") == 6).select(F.col("pkt_no").alias("seq"), "ts_us", "src", F.col("dport").alias("dst_port"), "payload")
    return tcp.mapInArrow(run, "seq bigint, ts_us bigint, src string, dst_port int, version string, fingerprint string")
