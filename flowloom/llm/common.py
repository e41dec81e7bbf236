"""Shared helpers of the text operators: scratch tables, Arrow passes and word splitting."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch. Texts reach hundreds of kilobytes, so rows alone are no bound.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def arrow_session(df: DataFrame) -> SparkSession:
    """The session of ``df``, whose limits of Arrow batches are lowered to the above; lower ones stay."""
    spark = df.sparkSession
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not (size.endswith("b") and 0 < int(size[:-1]) <= BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The local folder of a session that names none, by application.
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset and all runs on one machine, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            import tempfile

            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="scratch-")
        root = _LOCAL[app]
    return root.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. They cut lineage and outlive executors.

    ``drop`` removes a table that nothing reads any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, codec: str = "zstd") -> None:
        self.codec = codec
        self.spark, self.root = spark, f"{scratch_root(spark)}/flowloom-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.option("compression", self.codec).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``mapInArrow`` with a per-task state: ``make`` runs once a task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    arrow_session(df)
    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of a binary column; null counts as empty."""
    return [x or b"" for x in column.to_pylist()]


#: Bits of a map of keys: for each key, and at most (8 MB).
KEY_BITS, MOST_BITS = 32, 1 << 26


def parted(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``column`` is surely none of ``keys`` (one column), and those where it may be one.

    Each key sets the bit of its hash in a map that is broadcast, of bounded size. What shares a bit with a key goes
    to the second part, which a join with ``keys`` has to settle; only that part has to be shuffled. ``keys`` is
    read twice.
    """
    bits = min(MOST_BITS, 1 << max(15, (KEY_BITS * keys.count()).bit_length()))
    part, mask = "_part", "_mask"
    while {part, mask} & {c.lower() for c in rows.columns}:
        part, mask = part + "_", mask + "_"
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    set_bits = keys.select(F.shiftright(at(keys.columns[0]), 15).alias(part), at(keys.columns[0]).bitwiseAND(32767).alias("bit"))
    maps = set_bits.repartition(part).groupBy(part).agg(F.bitmap_construct_agg("bit").alias(mask))
    bit = at(column).bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(mask, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, bit.bitwiseAND(7)) == 1, F.lit(False))
    both = rows.withColumn(part, F.shiftright(at(column), 15)).join(F.broadcast(maps), part, "left")
    return both.where(~found).select(*rows.columns), both.where(found).select(*rows.columns)


def crc_mod(doc_id: str, mod: int) -> "F.Column":
    """``crc32`` of the decimal id as text, modulo ``mod``; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


class WordHashes(dict):
    """64-bit hash of a word, computed once a word; bounded by starting afresh."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply-xorshift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
