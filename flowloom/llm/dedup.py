"""Near-duplicate groups by HyperMinHash sketches, banding and exact verification.

A document's set holds its distinct word shingles (as 64-bit hashes). Documents of equal sets form
one class; everything below works on classes, so copies never meet in pairs.

* Sketch: the hash's first 8 bits choose one of 256 buckets; of the least remainder in a bucket, a
  register keeps the number of leading zeros and the next 10 bits. Empty buckets borrow from an
  occupied one by a fixed random preference, so that small sets fill all registers too.
* Banding: 42 bands of 6 registers. Classes that share a band are candidates. At similarity 0.8 a
  pair shares no band with a probability of about 3e-6.
* Estimation: the share of equal registers, corrected for registers that are equal by chance.
  Pairs more than ``MARGIN`` below the threshold go; sets of few shingles skip this step.
* Verification: candidates that remain are compared on their full sets.

In buckets of two, both classes are compared; in larger ones, every class with the pivots of its
``PIVOTS`` largest buckets. What passes the estimate is verified. In buckets whose classes the passed
pairs leave in several components, classes are estimated against each other, block against block, and
a spanning forest of the pairs that pass is added. The components of all pairs that passed hold every
possible link; where one holds several components of links, its classes are verified against each
other, again block against block. No candidate pair between two components of links is left untested,
and neither step returns more rows than it reads.

Inputs and edge cases: a text that is null or has no word has an empty set and is linked with
nothing; a text of fewer words than a shingle has its whole sequence as its only shingle; long texts
are read whole; repeated rows fall in one class; a null ``doc_id`` is kept and never becomes a
representative while its group has another id; an empty table gives an empty one; only ``doc_id`` and
``text`` are read, so further columns may bear any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow_session, map_arrow, mix64, parted, table

BUCKETS, MANTISSA = 256, 10
BANDS, ROWS = 42, 6
#: An estimate this far below the threshold rules a pair out: about six standard errors.
MARGIN = 0.15
#: Sets below this size are verified without an estimate.
SMALL = 48
#: Classes in a block; a task compares two blocks, or many buckets of up to one block.
BLOCK, SHARED = 512, 10_000
#: Pivots that a class is compared with first, besides the pairs of buckets of two.
PIVOTS = 3
WORDS = WordHashes()


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text, A-Z in lower case."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)
    if n < k:
        h = np.array([n], np.uint64)
        for i in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + 1])
        return h
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - k + 1 + j])
    return np.unique(h)


@lru_cache(maxsize=1)
def preference() -> np.ndarray:
    """For each register, the order in which it borrows from other buckets."""
    rng = np.random.default_rng(20240501)
    return np.argsort(rng.random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """256 registers of a non-empty sorted set: leading zeros (6 bits) and mantissa (10 bits)."""
    edge = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
    at = np.searchsorted(hashes, edge)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & (first >> np.uint64(56) == np.arange(BUCKETS, dtype=np.uint64))
    rest = ((first << np.uint64(8)) >> np.uint64(11)).astype(np.float64)
    part, exponent = np.frexp(np.maximum(rest, 1.0))
    value = ((53 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    if not full.all():
        own, empty = np.flatnonzero(full), np.flatnonzero(~full)
        value[empty] = value[own[preference()[np.ix_(empty, own)].argmin(axis=1)]]
    return value


def chance(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets are equal, for sets of these sizes."""
    n1, n2 = n1.astype(np.float64), n2.astype(np.float64)
    return 0.169919487 / (1 << MANTISSA) * 4 * n1 * n2 / np.maximum(n1 + n2, 1) ** 2


def estimate(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance."""
    c = chance(n1, n2)
    return (equal - c) / (1 - c)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``uid, doc_id, n, key, regs`` of every row; ``key`` identifies the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            n, key, regs = [], [], []
            for raw in b.column(1).to_pylist():
                s = shingle_set(raw or b"", k)
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            ids = pa.array(np.arange(uid, uid + b.num_rows))
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays([ids, b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["uid", "doc_id", "n", "key", "regs"])

    arrow_session(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "uid long, doc_id long, n long, key binary, regs binary")


def _estimated(pairs: DataFrame, sk: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``x, y`` of classes whose estimate doesn't rule them out."""
    rx = sk.select(F.col("uid").alias("x"), F.col("n").alias("nx"), F.col("regs").alias("gx"))
    ry = sk.select(F.col("uid").alias("y"), F.col("n").alias("ny"), F.col("regs").alias("gy"))

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y, nx, ny = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            gx = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            gy = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keep = _may_link((gx == gy).mean(axis=1), nx, ny, threshold)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["x", "y"])

        return fn

    both = pairs.join(rx, "x").join(ry, "y").select("x", "y", "nx", "ny", "gx", "gy")
    return map_arrow(both, "x long, y long", make)


def _may_link(equal: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    return (small >= threshold * large - 1e-9) & ((small < SMALL) | (estimate(equal, nx, ny) >= threshold - MARGIN))


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= ``percent`` * union of two sorted sets."""
    small, large = (s, t) if len(s) < len(t) else (t, s)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are linked, by their full sets."""
    tx = texts.select(F.col("uid").alias("x"), F.col("text").alias("tx"))
    ty = texts.select(F.col("uid").alias("y"), F.col("text").alias("ty"))

    def make():
        last: list = [None, None]

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for y, a, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last[0] != y:
                    last[:] = y, shingle_set(c, k)
                found.append(linked(shingle_set(a, k), last[1], percent))
            return b.select(["x", "y"]).filter(pa.array(found, pa.bool_()))

        return fn

    return map_arrow(pairs.join(tx, "x").join(ty, "y").select("x", "y", "tx", "ty"), "x long, y long", make)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each connected component, by alternating large and small stars.

    Nodes that no edge touches are absent. Each round is written to the shared folder.
    """
    e = scratch.save(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u <> v").distinct(), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = after
        if now == state:
            break
        state = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())


def _first_pairs(members: DataFrame) -> DataFrame:
    """The pair of each bucket of two, and every class with the pivots of its largest buckets."""
    order = Window.partitionBy("uid").orderBy(F.desc("size"), "pivot", "bucket")
    large = members.where("size > 2").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= PIVOTS)
    both = large.select("uid", "pivot").union(members.where("size = 2").select("uid", "pivot"))
    return both.where("uid <> pivot").select(F.col("uid").alias("x"), F.col("pivot").alias("y")).distinct()


class Forest:
    """Union-find over component labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _spanning(left: np.ndarray, right: np.ndarray, uid: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray, threshold: float, test: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs of different components, from ``left`` and ``right``, that pass the estimate and ``test``; as few as join them."""
    forest, out = Forest(), []
    for a in left:
        other = right[comp[right] != comp[a]]
        if not len(other):
            continue
        ok = _may_link((regs[other] == regs[a]).mean(axis=1), n[other], np.full(len(other), n[a]), threshold)
        for b in other[ok]:
            if forest.find(int(comp[a])) != forest.find(int(comp[b])) and test(a, b):
                forest.join(int(comp[a]), int(comp[b]))
                out.append((int(max(uid[a], uid[b])), int(min(uid[a], uid[b]))))
    return out


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (``key, uid, comp, size``) by pairs of blocks ``i, j`` of a key's classes, ``own`` being a class's block.

    A class goes to every pair that holds its own block, so a large key is spread over many tasks.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "comp")


def _arrays(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in names]


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    x, y = zip(*found, strict=True) if found else ((), ())
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def _estimated_forest(rest: DataFrame, sk: DataFrame, threshold: float) -> DataFrame:
    """Pairs that pass the estimate and join the components within each bucket. ``rest``: ``bucket, uid, comp, size``."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, own, i, j, uid, comp, n = _arrays(rows, "bucket", "own", "i", "j", "uid", "comp", "n")
        regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        order = np.argsort(bucket, kind="stable")
        found = []
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            found += _spanning(at[own[at] == i[at]], at[own[at] == j[at]], uid, comp, n, regs, threshold, lambda a, b: True)
        return _pairs(found)

    dealt = _blocks(rest, "bucket").join(sk, "uid")
    # Buckets of one block share groups of about SHARED classes; the pairs of blocks of larger ones have a group each.
    groups = max(1, -(-rest.count() // SHARED))
    tasks = F.when(F.col("i") == F.col("j"), F.pmod("bucket", F.lit(groups))).otherwise(F.col("bucket"))
    return dealt.withColumn("task", tasks).groupBy("task", "i", "j").applyInArrow(run, "x long, y long").distinct()


def _verified_forest(groups: DataFrame, sk: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that join the components within each group, by full sets. ``groups``: ``group, uid, comp, size``."""

    def run(rows: pa.Table) -> pa.Table:
        own, i, j, uid, comp, n = _arrays(rows, "own", "i", "j", "uid", "comp", "n")
        regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        sets = [shingle_set(t, k) for t in rows["text"].to_pylist()]
        return _pairs(_spanning(np.flatnonzero(own == i), np.flatnonzero(own == j), uid, comp, n, regs, percent / 100, lambda a, b: linked(sets[a], sets[b], percent)))

    dealt = _blocks(groups, "group").join(sk, "uid").join(texts, "uid")
    return dealt.groupBy("group", "i", "j").applyInArrow(run, "x long, y long").distinct()


def _grouped(docs: DataFrame, scratch: Scratch, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``uid, doc_id, n, key`` of every row, and ``key, component_id, root`` of every set.

    Registers and texts are wide: of them, only the rows that some pair may need are shuffled.
    """
    threshold = percent / 100
    sk = scratch.save(sketches(docs, shingle), "sketches")
    ids = sk.groupBy("key").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("low")).where("key is not null")
    classes = scratch.save(ids, "classes")
    rows = scratch.save(sk.select("uid", "doc_id", "n", "key"), "rows")
    copies = scratch.save(rows.where("key is not null").select("uid").join(classes.select("uid"), "uid", "left_anti"), "copies")
    single, unsure = parted(sk.where("key is not null").select("uid", "regs"), "uid", copies)
    reps = single.union(unsure.join(copies, "uid", "left_anti"))
    bands = reps.select("uid", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("regs", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])).alias("bucket"))
    # Written first, so that its size is known: where it is small, the bands are not dealt by bucket at all.
    shared = scratch.save(bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("uid").alias("pivot")).where("size > 1"), "shared")
    _, several = parted(bands, "bucket", shared.select("bucket"))
    members = scratch.save(several.join(shared, "bucket").select("bucket", "uid", "pivot", "size"), "members")
    ends = scratch.save(members.select("uid").distinct(), "ends")
    _, found = parted(sk.select("uid", "n", "regs"), "uid", ends)
    slim = scratch.save(found.join(ends, "uid", "left_semi"), "slim")
    scratch.drop(sk)

    first = scratch.save(_estimated(_first_pairs(members), slim, threshold), "pairs")
    # One pass over the texts serves both verifications: large buckets may need theirs later on.
    need = _ends(first).union(members.where("size > 2").select("uid")).distinct()
    wanted = scratch.save(rows.join(need, "uid", "left_semi").select("uid", F.col("doc_id").alias("_id"), "key"), "wanted")
    texts = scratch.save(_texts(docs, wanted, shingle), "texts")
    links = scratch.save(_verified(first, texts, shingle, percent), "links")
    comps = scratch.save(components(scratch, links), "components")
    # Components of the pairs that passed the estimate; only buckets that hold several need more estimates.
    near = scratch.save(components(scratch, first), "near")
    large = scratch.save(_labelled(members.where("size > 2").select("bucket", "uid", "size"), near), "large")
    mixed = scratch.save(_mixed(large, "bucket"), "mixed")
    rest = scratch.save(large.join(mixed, "bucket", "left_semi"), "rest")
    more = scratch.save(_estimated_forest(rest, slim, threshold), "pairs")
    if not more.isEmpty():
        near = scratch.save(components(scratch, first.union(more)), "near")
    # Those that hold several components of links are verified whole.
    sizes = near.groupBy("root").agg(F.count("*").alias("size"))
    groups = _labelled(near.join(sizes, "root").select(F.col("root").alias("group"), F.col("node").alias("uid"), "size"), comps)
    groups = scratch.save(groups.join(_mixed(groups, "group").select("group"), "group", "left_semi"), "groups")
    if not groups.isEmpty():
        links = links.union(scratch.save(_verified_forest(groups, slim, texts, shingle, percent), "links"))
        comps = scratch.save(components(scratch, links), "components")
    scratch.drop(texts, members, rest, large, slim)
    named = classes.join(comps, classes["uid"] == comps["node"], "left").select("key", "low", F.coalesce("root", "uid").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, named.join(lows, "root").select("key", "component_id", "root")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Linked: 100 * intersection >= ``percent`` * union of the sets. ``component_id`` is the least id
    that links reach.
    """
    scratch = Scratch(docs.sparkSession, "snappy")  # many small tables: no native buffers for each
    rows, of_key = _grouped(docs, scratch, shingle, percent)
    return _rows_of(rows, of_key)


def _rows_of(rows: DataFrame, of_key: DataFrame) -> DataFrame:
    out = rows.select("doc_id", "n", "key").join(of_key.select("key", "component_id"), "key", "left")
    comp = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("uid")).union(pairs.select(F.col("y").alias("uid"))).distinct()


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with ``comp``, the component of ``uid``."""
    labels = comps.select(F.col("node").alias("uid"), F.col("root").alias("comp"))
    return rows.join(labels, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose rows lie in several components."""
    return rows.groupBy(key).agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select(key)


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``uid, text`` of the classes in ``wanted`` (``uid, _id, key``); rows that share an id but not the set go by their key.

    What is wanted grows with the documents, so both are dealt by id at every size; rows of other ids stay out of that.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    _, raw = parted(raw, "doc_id", wanted.select("_id"))
    both = raw.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("uid", "key", "text")

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = [hashlib.md5(shingle_set(t or b"", k).tobytes()).digest() == key for key, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            return b.select(["uid", "text"]).filter(pa.array(keep, pa.bool_()))

        return fn

    return map_arrow(both, "uid long, text binary", make).dropDuplicates(["uid"])


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the least id, with all its columns.

    Ids that one row has decide by themselves. Of rows without an id, and of rows that share one, a group keeps
    the one of the least set key if its least id is theirs (null only where no other row has one); texts
    without a word are linked with nothing: those that share an id are kept once, those without one all.
    """
    scratch = Scratch(docs.sparkSession, "snappy")
    rows, of_key = _grouped(docs, scratch, shingle, percent)
    of_key = scratch.save(of_key, "groups")
    each = _rows_of(rows, of_key).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    ids = scratch.save(each, "kept")
    gone = scratch.save(ids.where("not kept or rows > 1").select("doc_id"), "dropped")
    stay, unsure = parted(docs.where("doc_id is not null"), "doc_id", gone)
    out = stay.union(unsure.join(gone, "doc_id", "left_anti").select(*docs.columns))
    again = ids.where("rows > 1").select("doc_id")
    _, repeated = parted(docs, "doc_id", again)
    unclear = docs.where("doc_id is null").union(repeated.join(again, "doc_id", "left_semi").select(*docs.columns))

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = (shingle_set((t or b""), shingle) for t in b.column(2).to_pylist())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary())], names=["row", "id", "key"])

        return fn

    packed = unclear.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    schema = packed.select("row", "id", F.lit(None).cast("binary").alias("key")).schema
    keyed = scratch.save(map_arrow(packed, schema, make), "unclear")
    if keyed.isEmpty():
        return out
    own = keyed.join(of_key, "key").where(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = own.groupBy("root").agg(F.min_by("row", "key").alias("row"))
    blank = keyed.where("key is null")
    once = blank.where("id is not null").groupBy("id").agg(F.first("row").alias("row"))
    rest = chosen.select("row").union(once.select("row")).union(blank.where("id is null").select("row"))
    return out.union(rest.select("row.*"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents, on 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op1_sql() -> str:
    """DuckDB SQL for ``op1_near_dedup``: all pairs that share a shingle, and what links reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, [w for w in string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)
  UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b WHERE 100 * shared >= 80 * (u.n + v.n - shared)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN low l ON l.a = d.doc_id
"""
