"""Packet captures as a Spark data source.

``spark.read.format("pcap").load(path)`` gives one row a record, dissected down to the transport layer;
columns and predicates above it are ordinary Catalyst. A capture has no index, so one task reads one
file, in bounded memory. For stores that only Spark's readers open, ``from_binary`` dissects the
``content`` of the ``binaryFile`` source instead.

Options: ``fraction`` is ``us`` (default: the fraction field counts microseconds whatever the magic
says) or ``magic`` (nanosecond magics count nanoseconds).
"""

from __future__ import annotations

import glob
import io
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from flowloom.functions.text import mapped_or_slug

SCHEMA = (
    "capture_file string, pkt_no bigint, ts_us bigint, incl_len int, orig_len bigint, status string, vlan_tags int, proto int, src string, dst string, sport int, dport int, "
    "tcp_flags int, win int, ip_hdr_len int, l4_hdr_len int, ip_total int, payload_len int, ident binary, payload binary"
)
#: The first four bytes of a file, its byte order and the fraction's units a second.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
NEXT_GENERATION = b"\x0a\x0d\x0d\x0a"
LIMIT = 1 << 31
PAYLOAD = 512
#: Top directories of a capture collection and their families.
FAMILIES = {
    "flash traffic": "flash_traffic",
    "http flood_get_post_random": "http_flood",
    "http low volume low rate": "http_low_rate",
    "http-low volume-slow rate-slow body": "http_slow_body",
    "http-low volume-slow rate-slow header": "http_slow_header",
    "http-low volume-slow rate-slow read": "http_slow_read",
    "legitimate traffic": "benign",
    "tcp-rst": "tcp_rst",
    "tcp-syn-fast": "tcp_syn_fast",
    "tcp-syn-flood": "tcp_syn_flood",
    "tcp-syn-low": "tcp_syn_low",
    "udp flood": "udp_flood",
}


class CaptureError(ValueError):
    """The file is no capture that can be read."""


def records(stream: BinaryIO, fraction: str = "us") -> Iterator[tuple[int, int, int, bytes]]:
    """``(ts_us, incl_len, orig_len, frame)`` of every whole record; a cut-off last record is left out."""
    head = stream.read(24)
    if head[:4] == NEXT_GENERATION:
        raise CaptureError("pcapng files are not supported")
    if len(head) < 24 or head[:4] not in MAGICS:
        raise CaptureError("no capture file header")
    order, units = MAGICS[head[:4]]
    units = 10**6 if fraction == "us" else units
    header = struct.Struct(order + "4I")
    while len(raw := stream.read(16)) == 16:
        seconds, part, size, wire = header.unpack(raw)
        if size > LIMIT:
            raise CaptureError(f"a record of {size} bytes is not plausible")
        frame = stream.read(size)
        if len(frame) < size:
            return
        yield seconds * 10**6 + (part if units == 10**6 else part // 1000), size, wire, frame


def dissect(frame: bytes) -> tuple:
    """From ``status`` on, the columns of ``SCHEMA``; what is not there is None.

    ``status``: parsed, non_ip, malformed or frag (a fragment that is not the first has no ports).
    """
    tags = 0

    def no(status: str) -> tuple:
        return (status, tags, *[None] * 13)

    at = 12
    while True:
        if len(frame) < at + 2:
            return no("malformed")
        (kind,) = struct.unpack_from(">H", frame, at)
        at += 2
        if kind != 0x8100:
            break
        if len(frame) < at + 4:
            return no("malformed")
        tags += 1
        at += 2
    if kind != 0x0800:
        return no("non_ip")
    ip = memoryview(frame)[at:]
    if len(ip) < 20:
        return no("malformed")
    ip_header = (ip[0] & 15) * 4
    if ip_header < 20 or len(ip) < ip_header:
        return no("malformed")
    total, _, fragment = struct.unpack_from(">HHH", ip, 2)
    if fragment & 0x1FFF:
        return no("frag")
    proto, rest = ip[9], ip[ip_header:]
    sport = dport = flags = window = transport = 0
    ident = b""
    if proto == 6:
        if len(rest) < 20 or (transport := (rest[12] >> 4) * 4) < 20:
            return no("malformed")
        sport, dport = struct.unpack_from(">HH", rest)
        flags, window = rest[13], struct.unpack_from(">H", rest, 14)[0]
        ident = bytes(rest[4:12])
    elif proto == 17:
        if len(rest) < 8:
            return no("malformed")
        sport, dport = struct.unpack_from(">HH", rest)
        transport = 8
    elif proto == 1:
        transport = 8
    payload = bytes(rest[transport : transport + PAYLOAD])
    src, dst = (".".join(map(str, ip[k : k + 4])) for k in (12, 16))
    return ("parsed", tags, proto, src, dst, sport, dport, flags, window, ip_header, transport, total, max(total - ip_header - transport, 0), ident or payload[:8], payload)


def rows(name: str, stream: BinaryIO, fraction: str = "us") -> Iterator[tuple]:
    for number, (ts, size, wire, frame) in enumerate(records(stream, fraction), 1):
        yield (name, number, ts, size, wire, *dissect(frame))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _captures(path: str) -> list[str]:
    """Captures of a folder and those below it, or what a pattern names."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith((".pcap", ".cap")))
    return sorted(glob.glob(path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        found = _captures(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb", buffering=1 << 22) as f:
            yield from rows(os.path.basename(partition.path), f, self.options.get("fraction", "us"))


class _StreamReader(DataSourceStreamReader):
    """Capture files that are added to a folder or below it; each is read by one task.

    A file is known by when it was last changed and its name, so one that comes late is read whatever it is
    called. The offset is the latest such pair; a capture is to be moved into the folder when it is complete.
    """

    def __init__(self, options: dict) -> None:
        self.options = options

    def _known(self) -> list[tuple[int, str]]:
        return sorted((os.stat(p).st_mtime_ns, p) for p in _captures(self.options["path"]))

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def latestOffset(self, *_) -> dict:
        time, name = max(self._known(), default=(0, ""))
        return {"time": time, "name": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((x["time"], x["name"]) for x in (start, end))
        return [_File(p) for t, p in self._known() if low < (t, p) <= high]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb", buffering=1 << 22) as f:
            yield from rows(os.path.basename(partition.path), f, self.options.get("fraction", "us"))

    def commit(self, end: dict) -> None:
        pass


class PcapDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)


def from_binary(files: DataFrame, fraction: str = "us") -> DataFrame:
    """Packets of ``path, content`` rows, as ``spark.read.format("binaryFile")`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out: list[tuple] = []
                for row in rows(path.rsplit("/", 1)[-1], io.BytesIO(content.as_buffer()), fraction):
                    out.append(row)
                    if len(out) == 20_000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SCHEMA.split(", ")])


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)


def capture_stats(packets: DataFrame) -> DataFrame:
    """Per capture: records, bytes on the wire, first and last time, and records by parse status."""
    kinds = ("parsed", "non_ip", "malformed", "frag")
    return packets.groupBy("capture_file").agg(
        F.count("*").alias("packets"), F.sum("orig_len").alias("bytes_wire"), F.min_by("ts_us", "pkt_no").alias("first_us"), F.max_by("ts_us", "pkt_no").alias("last_us"),
        ((F.max_by("ts_us", "pkt_no") - F.min_by("ts_us", "pkt_no")) / 1e6).alias("duration_s"),
        F.count_if(F.col("orig_len") < F.col("incl_len")).alias("n_orig_lt_incl"), F.count_if(F.col("incl_len") == 0).alias("n_bad_incl"), F.sum("vlan_tags").alias("vlan_frames"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds],
    )


HEADERS = "path string, byte_order string, units_a_second long, snaplen long, linktype long, records long, cut_tail boolean, error string"


def headers(files: DataFrame) -> DataFrame:
    """Of ``path, content`` rows: what the file header says, whole records, and whether the last one is cut off; or why it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                order, units = MAGICS.get(bytes(raw[:4]), (None, None))
                if order is None or len(raw) < 24:
                    out.append((path, None, None, None, None, None, None, "pcapng" if bytes(raw[:4]) == NEXT_GENERATION else "no capture file header"))
                    continue
                snaplen, link = struct.unpack_from(order + "II", raw, 16)
                at, n, fault = 24, 0, None
                while at + 16 <= len(raw):
                    size = struct.unpack_from(order + "I", raw, at + 8)[0]
                    if size > LIMIT:
                        fault = f"a record of {size} bytes is not plausible"
                        break
                    if at + 16 + size > len(raw):
                        break
                    at, n = at + 16 + size, n + 1
                out.append((path, "little" if order == "<" else "big", units, snaplen, link, n, at < len(raw), fault))
            names = [f.split()[0] for f in HEADERS.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*out, strict=True), HEADERS.split(", "), strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, HEADERS)


def family_of(top: Column) -> Column:
    return mapped_or_slug(F.lower(top), FAMILIES)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Captures below ``root``, with size and the family that their top directory names; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = F.regexp_replace(F.lit(root.removeprefix("file://").rstrip("/")), "^/*", "/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.concat(F.lit("^"), F.regexp_replace(base, r"([.+(){}\[\]])", r"\\$1"), F.lit("/")), F.lit(""))
    top = F.url_decode(F.split_part(below, F.lit("/"), F.lit(1)))
    family = family_of(top)
    layer = F.when(F.startswith(family, F.lit("http")), "application").when(F.startswith(family, F.lit("tcp")) | F.startswith(family, F.lit("udp")), "transport").otherwise("mixed")
    return files.where(F.col("path").rlike(r"\.p?cap$")).select("path", F.col("length").alias("size"), top.alias("top"), family.alias("family"), layer.alias("layer"), F.when(family == "benign", "benign").otherwise("attack").alias("binary_label"))


def write_pcap(path: str, frames: list[tuple[int, bytes]], magic: bytes = b"\xd4\xc3\xb2\xa1") -> None:
    """A capture of ``(ts_us, frame)`` rows, for fixtures."""
    order, units = MAGICS[magic]
    with open(path, "wb") as f:
        f.write(magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1))
        for ts, frame in frames:
            part = ts % 10**6 * (units // 10**6)
            f.write(struct.pack(order + "4I", ts // 10**6, part, len(frame), len(frame)) + frame)


def frame(src: str, dst: str, proto: int = 6, sport: int = 0, dport: int = 0, payload: bytes = b"", flags: int = 16, window: int = 1024, tags: int = 0, seq: int = 0) -> bytes:
    """An Ethernet frame with an IPv4 packet, for fixtures."""
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 5 << 4, flags, window, 0, 0)
    elif proto == 17:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    else:
        l4 = bytes(8) if proto == 1 else b""
    total = 20 + len(l4) + len(payload)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, total, 0, 0, 64, proto, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return bytes(12) + b"\x81\x00\x00\x01" * tags + b"\x08\x00" + ip + l4 + payload
