"""Language-model scoring by prediction by partial matching over bytes, with word-count base scores.

Model: the byte contexts of up to five bytes of all training texts, a trie whose deepest level is
counted and whose upper levels follow from it. A byte is predicted in the longest context that
training has seen; the escape probability is q / (T + q) for q distinct symbols among T (method C);
after an escape the symbols of the longer context are excluded from the shorter one; below order 0,
all bytes left are equally likely. A text begins after five zero bytes and ends with one. Each
6-byte string has one probability, so the trie is turned into a table of those that texts hold.

Flow: texts are cut into chunks of about ``CHUNK`` bytes in the order they are read; each chunk gives
its distinct words and 6-byte strings with training counts. Those are summed over the corpus. Strings
travel packed, a row for each chunk and bucket, a bucket being a hash of the last two context bytes;
so the orders from two on are complete in a bucket, and the lower ones follow from counts of byte
pairs. Buckets are summed over ``FAN`` chunks at a time, and their tables come back to the chunks by
as many. Nothing that grows with the corpus is broadcast or collected. Words are counted by 64-bit
hashes.

Inputs and edge cases: a null text counts as empty and is the end alone; texts are read whole, and
one that is longer than a chunk is one chunk; repeated rows are learnt from and scored each; without
training texts every byte has the probability 1/256; a null ``doc_id`` counts as the empty string for
the split; an empty table gives an empty one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow_session, crc_mod, table

CHUNK = 24_000_000
#: Bytes handled at once within a chunk.
PART = 1_500_000
ORDER = 5
#: Groups of strings by their last two context bytes; chunks whose strings are handled at once.
BUCKETS, FAN = 256, 256
DOC, WORD, GRAM, PAIR = 0, 1, 2, 3
PASS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("held_out", pa.bool_()), ("key", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
WORDS = WordHashes()


def word_ids(low: bytes) -> np.ndarray:
    words = low.split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words)).view(np.int64)


def grams(texts: list[bytes], order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``order + 1`` bytes that end at each byte (and end mark) of the texts, and how many each text has."""
    pad = b"\0" * order
    flat = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.zeros(len(flat), np.int64)
    for back in range(order + 1):
        code[back:] |= flat[: len(flat) - back].astype(np.int64) << (8 * back)
    keep = np.ones(len(flat), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    for k in range(order):
        keep[starts + k] = False
    return code[keep], sizes


def bucket_of(code: np.ndarray) -> np.ndarray:
    return (((code >> 8) & 65535) * 40503 & 65535) * BUCKETS >> 16


def packed(column: np.ndarray) -> bytes:
    """A column of numbers as compressed planes of bytes."""
    return pa.compress(column.view(np.uint8).reshape(len(column), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending order."""
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n, np.int64))


class Tally:
    """Counts of keys, added in parts; a key may have the count 0."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counted: bool) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.put(k, n if counted else np.zeros(len(n), np.int64))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > max(3_000_000, 2 * len(self.keys[0])):
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            # Runs in ascending order, which a stable sort merges.
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.counts = [keys[first]], [np.add.reduceat(counts[order], first)]
            self.size = len(first)
        return self.keys[0], self.counts[0]


def gather(docs: DataFrame, held_out: Column) -> DataFrame:
    """The texts by chunk, and each chunk's words, byte pairs and strings with their training counts."""

    def rows(size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(size, f.type) for f in PASS], schema=PASS)

    def same(n: int, value: int) -> pa.Array:
        return pa.array(np.full(n, value, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        tallies, size = {WORD: Tally(), GRAM: Tally()}, 0
        parts: dict[bool, list[bytes]] = {True: [], False: []}

        def count(held: bool) -> None:
            texts, parts[held] = parts[held], []
            if texts:
                tallies[WORD].add(np.concatenate([word_ids(t) for t in texts]), not held)
                tallies[GRAM].add(grams(texts, ORDER)[0], not held)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = tallies[GRAM].result()
            pairs = np.bincount(keys & 65535, counts, 65536).astype(np.int64)
            for kind, k, n in ((WORD, *tallies[WORD].result()), (PAIR, np.flatnonzero(pairs), pairs[pairs > 0])):
                for at in range(0, len(k), 100_000):
                    part = k[at : at + 100_000]
                    yield rows(len(part), kind=same(len(part), kind), chunk=same(len(part), chunk), key=pa.array(part), n=pa.array(n[at : at + 100_000]))
            bucket = bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, counts = bucket[order], keys[order], counts[order]
            found, first = np.unique(bucket, return_index=True)
            cuts = [slice(a, b) for a, b in zip(first, np.append(first, len(keys))[1:], strict=True)]
            if cuts:
                yield rows(len(cuts), kind=same(len(cuts), GRAM), chunk=same(len(cuts), chunk), key=pa.array(found), n=pa.array([c.stop - c.start for c in cuts]), keys=pa.array([packed_keys(keys[c]) for c in cuts]), counts=pa.array([packed(counts[c]) for c in cuts]))
            tallies.update({WORD: Tally(), GRAM: Tally()})

        for b in batches:
            ids, raw, held = (b.column(k) for k in range(3))
            first = 0
            waiting = {h: sum(map(len, parts[h])) for h in parts}
            for i, (t, h) in enumerate(zip(raw.to_pylist(), held.to_pylist(), strict=True)):
                low = (t or b"").lower()
                parts[h].append(low)
                waiting[h] += len(low)
                size += len(low)
                if waiting[h] >= PART:
                    count(h)
                    waiting[h] = 0
                if size >= CHUNK or i == b.num_rows - 1:
                    n = i + 1 - first
                    yield rows(n, kind=same(n, DOC), chunk=same(n, chunk), doc_id=ids.slice(first, n), text=raw.slice(first, n), held_out=held.slice(first, n))
                    first = i + 1
                if size >= CHUNK:
                    count(True)
                    count(False)
                    waiting = {True: 0, False: 0}
                    yield from flush()
                    chunk, size = chunk + 1, 0
        count(True)
        count(False)
        yield from flush()

    arrow_session(docs)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), held_out.alias("held_out"))
    return source.mapInArrow(run, "kind int, chunk long, doc_id long, text binary, held_out boolean, key long, n long, keys binary, counts binary")


def code_lengths(codes: np.ndarray, n: np.ndarray, last: int | np.ndarray, first_order: np.ndarray, order: int = 3) -> np.ndarray:
    """log10 probabilities of the distinct strings ``codes`` of ``order + 1`` bytes whose last context byte is ``last``.

    ``n``: their training counts; all strings of training that share the last two context bytes with
    one of them must be there.
    ``first_order[c, s]``: how often training has the byte ``s`` after ``c``.
    """
    s, last = codes & 255, np.broadcast_to(last, len(codes))
    c0 = first_order.sum(axis=0)
    q0 = int((c0 > 0).sum())
    out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)

    def level(c: np.ndarray, t: np.ndarray, q: np.ndarray, lowest: bool = False) -> None:
        """Counts of the strings, and what their contexts have less the symbols that are excluded."""
        nonlocal out, open_
        escape = 0 * q if lowest and q0 == 256 else q
        here = open_ & (c > 0)
        out = np.where(here, out + np.log10(c / (t + escape)), out)
        open_ = open_ & ~here
        out = np.where(open_ & (q > 0), out + np.log10(escape / (t + escape)), out)

    with np.errstate(divide="ignore", invalid="ignore"):
        # Of each level: strings with their counts, contexts, and where the rows are among the strings.
        keys, c, row = codes, n.astype(np.float64), np.arange(len(codes))
        above = None
        for depth in range(order, 1, -1):
            if above is not None:
                keys, at = np.unique(keys & ((1 << (8 * depth + 8)) - 1), return_inverse=True)
                upper, c = c, np.bincount(at, c, len(keys))
                row = at[row]
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            t, q = np.bincount(of, c, len(contexts)), np.bincount(of, c > 0, len(contexts))
            if above is None:
                level(c[row], t[of[row]], q[of[row]])
            else:
                gone = np.bincount(above[0], np.where(upper > 0, c[at], 0.0), len(above[1]))
                level(c[row], t[of[row]] - gone[above[2]], q[of[row]] - above[1][above[2]])
            above = of, q, of[row]
        seen = first_order[(keys >> 8) & 255, keys & 255]
        gone = np.bincount(above[0], np.where(c > 0, seen, 0.0), len(above[1]))
        t1, q1 = first_order.sum(axis=1)[last], (first_order > 0).sum(axis=1)[last]
        level(first_order[last, s], t1 - gone[above[2]], q1 - above[1][above[2]])
        level(c0[s], c0.sum() - ((first_order > 0) * c0).sum(axis=1)[last], q0 - q1, lowest=True)
        return np.where(open_, out - np.log10(max(256 - q0, 1)), out)


def summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Strings of packed rows with their counts."""
    tally = Tally()
    for n, keys, counts in zip(rows["n"].to_pylist(), rows["keys"], rows["counts"], strict=True):
        tally.put(unpacked_keys(keys.as_py(), n), unpacked(counts.as_py(), n, np.int64))
    return tally.result()


def share_of(strings: DataFrame, chunks: int, first_order: np.ndarray) -> DataFrame:
    """``chunk, key, n, keys, logs``: log10 probabilities of the packed strings (``chunk, key, n, keys, counts``) of each chunk."""
    batches = max(1, -(-chunks // FAN))

    def add(rows: pa.Table) -> pa.Table:
        keys, counts = summed(rows)
        return pa.table({"key": rows["key"][:1], "n": [len(keys)], "keys": [packed_keys(keys)], "counts": [packed(counts)]})

    def model(rows: pa.Table) -> pa.Table:
        keys, counts = summed(rows)
        logs = code_lengths(keys, counts, (keys >> 8) & 255, first_order, ORDER).astype(np.float32)
        return pa.table({"key": rows["key"][:1], "n": [len(keys)], "keys": [packed_keys(keys)], "logs": [packed(logs)]})

    def give(rows: pa.Table, known: pa.Table) -> pa.Table:
        size = known["n"][0].as_py()
        keys, logs = unpacked_keys(known["keys"][0].as_py(), size), unpacked(known["logs"][0].as_py(), size, np.float32)
        own = [packed(logs[np.searchsorted(keys, unpacked_keys(k.as_py(), n))]) for n, k in zip(rows["n"].to_pylist(), rows["keys"], strict=True)]
        return pa.table({"chunk": rows["chunk"], "key": rows["key"], "n": rows["n"], "keys": rows["keys"], "logs": pa.array(own, pa.binary())})

    strings = strings.withColumn("batch", F.pmod(F.xxhash64("chunk"), F.lit(batches)))
    sums = strings.select("key", "batch", "n", "keys", "counts").groupBy("key", "batch").applyInArrow(add, "key long, n long, keys binary, counts binary")
    known = sums.groupBy("key").applyInArrow(model, "key long, n long, keys binary, logs binary")
    known = known.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    return strings.select("chunk", "key", "batch", "n", "keys").groupBy("key", "batch").cogroup(known.groupBy("key", "batch")).applyInArrow(give, "chunk long, key long, n long, keys binary, logs binary")


def lookup(code: np.ndarray, value: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Finds the values of strings that are all in ``code``, in a table by hash with linear probing."""
    bits = max(4, (2 * len(code)).bit_length())
    keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, value.dtype)
    last = (1 << bits) - 1

    def slot(g: np.ndarray) -> np.ndarray:
        return (g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    at, left = slot(code), np.arange(len(code))
    while len(left):
        free = keys[at] < 0
        keys[at[free]] = code[left[free]]
        done = keys[at] == code[left]
        values[at[done]] = value[left[done]]
        at, left = (at[~done] + 1) & last, left[~done]

    def find(g: np.ndarray) -> np.ndarray:
        g = g.astype(np.int64)
        at = slot(g)
        out, miss = values[at], np.flatnonzero(keys[at] != g)
        at = at[miss]
        while len(miss):
            if (keys[at] < 0).any():
                raise KeyError("a string is not in the table")
            at = (at + 1) & last
            out[miss] = values[at]
            wrong = keys[at] != g[miss]
            at, miss = at[wrong], miss[wrong]
        return out

    return find


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Token counts, base score and model score of every text, learning from those not held out."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    seen = scratch.save(gather(docs, held_out), "chunks")
    words = scratch.save(seen.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "words")
    found = seen.where(F.col("kind") == DOC).agg(F.count(F.when(~F.col("held_out"), 1)).alias("ends"), F.countDistinct("chunk").alias("chunks")).first()
    ends = found["ends"]
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    # At most 65,536 rows: pairs of bytes.
    pairs = seen.where(F.col("kind") == PAIR).groupBy(F.col("key").alias("pair")).agg(F.sum("n").alias("n")).collect()
    first_order = np.zeros(65536)
    for r in pairs:
        first_order[r["pair"]] = r["n"]
    first_order = first_order.reshape(256, 256)
    own = seen.where(F.col("kind") == WORD).select("chunk", "key").join(words, "key")
    strings = share_of(seen.where(F.col("kind") == GRAM).select("chunk", "key", "n", "keys", "counts"), found["chunks"], first_order)
    null = F.lit(None).cast("binary")
    share = own.select(F.col("chunk").alias("part"), F.lit(WORD).alias("kind"), "key", "n", null.alias("keys"), null.alias("logs")).union(strings.select("chunk", F.lit(GRAM), "key", "n", "keys", "logs"))
    scale = np.log10(tokens + distinct + 1)

    def run(texts: pa.Table, model: pa.Table) -> pa.Table:
        kind, key, value = (model[c].to_numpy() for c in ("kind", "key", "n"))
        w = kind == WORD
        order = np.argsort(key[w])
        wkey, wcount = key[w][order], value[w][order]
        rows = model.filter(pa.array(~w))
        code = [unpacked_keys(k.as_py(), n) for n, k in zip(rows["n"].to_pylist(), rows["keys"], strict=True)]
        logp = [unpacked(v.as_py(), n, np.float32) for n, v in zip(rows["n"].to_pylist(), rows["logs"], strict=True)]
        find = lookup(np.concatenate(code), np.concatenate(logp))
        raw = texts["text"].to_pylist()
        n_tokens, n_known, base, model_score = (np.empty(len(raw), t) for t in (np.int64, np.int64, np.float64, np.float64))
        end_base = np.log10(ends + 1) - scale
        first = size = 0
        for i, t in enumerate(raw):
            size += len(t)
            if size >= PART or i == len(raw) - 1:
                low = [x.lower() for x in raw[first : i + 1]]
                g, sizes = grams(low, ORDER)
                points = find(g)
                model_score[first : i + 1] = np.add.reduceat(points.astype(np.float64), np.cumsum(sizes) - sizes)
                for j, x in enumerate(low, first):
                    ids = word_ids(x)
                    c = wcount[np.searchsorted(wkey, ids)]
                    n_tokens[j], n_known[j] = len(ids) + 1, int((c > 0).sum()) + (ends > 0)
                    base[j] = np.log10(c + 1).sum() - len(ids) * scale + end_base
                first, size = i + 1, 0
        same = pa.array(np.full(len(raw), tokens, np.int64))
        return pa.table([texts["doc_id"], texts["held_out"], pa.array(n_tokens), pa.array(n_known), same, pa.array(base), pa.array(model_score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = seen.where(F.col("kind") == DOC).select("chunk", "doc_id", F.coalesce("text", F.lit(b"")).alias("text"), "held_out")
    return texts.groupBy("chunk").cogroup(share.groupBy("part")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with crc32(doc_id) mod 7 = 2 are held out."""
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
