"""Nearest neighbours by randomly rotated one-bit codes and exact reranking.

Index: the distinct vectors are dealt to the nearest of some centroids (lists). Less its centroid, a
vector is normalised, rotated by a fixed random rotation and reduced to the signs of its components. With the
packed signs it keeps its distance from the centroid and the inner product f of the code with the vector it
stands for. A query is rotated likewise and rounded to four bits a component, so that the code's inner
product is a sum of popcounts over packed bits. Divided by f it estimates the cosine, off by at most EPSILON *
(sqrt((1 - f**2) / f**2) / sqrt(D - 1) + the rounding's deviation) with high probability. Per query, vectors
whose lower bound of the distance is within the k-th least upper bound are reranked by their exact distance.

Flow: equal vectors form a class that keeps its k + 1 least ids, so copies cost nothing. A query first searches
the list it would lie in; the distance of the last one found, and the triangle inequality over a list's centroid
and radius, then rule out lists that can hold nothing nearer. So lists save work where vectors cluster
and never cost recall. A list lies in blocks of ``BLOCK`` classes, its queries in blocks of ``QUERIES``; a task searches one
block for one block of queries and returns k + 1 classes a query. Centroids are fitted on at most ``SAMPLE`` vectors.

Inputs and edge cases: vectors that are null, empty, zero or hold a null or non-finite component take
no part; vectors are compared with those of their dimension only; equal distances are ordered by the
id; rows of one id count each; rows of a null id take no part; with fewer candidates than k, all are
returned; an empty table gives an empty one; further columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_session, table

BLOCK, QUERIES, SAMPLE = 8192, 512, 4096
#: Centroids of a dimension, at most, and rounds of fitting them.
LISTS, ROUNDS = 512, 6
EPSILON, BITS = 2.5, 4
PACKED = "dim int, list int, block int, ids binary, lows binary, vectors binary, codes binary, scalars binary, limits binary"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes, and per vector its distance from the centre and f."""
    off = vectors.astype(np.float64) - centre
    norm = np.sqrt((off**2).sum(axis=1))
    turned = off @ rotation(vectors.shape[1]) / np.maximum(norm, 1e-300)[:, None]
    f = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.stack([norm, np.where(norm > 0, f, 1.0)], axis=1).astype(np.float32)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bytes as rows of 64-bit words."""
    pad = -bits.shape[1] % 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)))).view(np.uint64)


def products(turned: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of one rotated query with the sign codes, from popcounts, and the deviation of its rounding."""
    dim, top = len(turned), (1 << BITS) - 1
    low = float(turned.min())
    step = float(turned.max() - low) / top or 1.0
    level = np.rint((turned - low) / step).astype(np.uint8)
    planes = _words(np.packbits((level[None, :] >> np.arange(BITS)[:, None]) & 1, axis=1))
    inside = sum(np.bitwise_count(words & planes[j]).sum(axis=1, dtype=np.int64) << j for j in range(BITS))
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    whole = dim * low + step * int(level.sum(dtype=np.int64))
    return (2 * (low * ones + step * inside) - whole) / np.sqrt(dim), step / np.sqrt(12)


def distances(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed component by component."""
    return np.sqrt(np.cumsum((vectors - q) ** 2, axis=1)[:, -1]) if len(vectors) else np.empty(0)


def search(queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, lows: np.ndarray, centre: np.ndarray, k: int, limits: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ``k`` nearest rows found, ``(positions, distances)``, by distance and least id.

    ``limits``: a distance for each query beyond which nothing is wanted.
    """
    dim = vectors.shape[1]
    off = queries.astype(np.float64) - centre
    far = np.sqrt((off**2).sum(axis=1))
    turned = off @ rotation(dim) / np.maximum(far, 1e-300)[:, None]
    words, norm, f = _words(codes), scalars[:, 0].astype(np.float64), scalars[:, 1].astype(np.float64)
    loss = np.sqrt(np.maximum(1 - f**2, 0)) / np.sqrt(max(dim - 1, 1))
    exact, out = vectors.astype(np.float64), []
    for i, (q, t, r) in enumerate(zip(queries.astype(np.float64), turned, far, strict=True)):
        cos, rounding = products(t, words)
        middle = norm**2 + r**2 - 2 * norm * r * cos / f
        slack = 2 * norm * r * (EPSILON * (loss + rounding) / f + 1e-5)
        # A rounding of the scalars themselves.
        bound = np.inf if limits is None else limits[i] ** 2 * (1 + 1e-5) + 1e-9
        if len(lows) > k:
            bound = min(bound, np.partition(middle + slack, k - 1)[k - 1])
        where = np.flatnonzero(middle - slack <= bound)
        distance = distances(q, exact[where])
        best = np.lexsort((lows[where], distance))[:k]
        out.append((where[best], distance[best]))
    return out


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by a few rounds of Lloyd's algorithm, the same wherever it runs; lists that run empty stay where they were."""
    lists = max(1, min(lists, len(sample)))
    centroids = sample[np.sort(np.random.default_rng(11).choice(len(sample), lists, replace=False))].copy()
    for _ in range(ROUNDS if lists > 1 else 0):
        own = nearest_centroid(sample, centroids)[0]
        size = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids[size > 0] = total[size > 0] / size[size > 0][:, None]
    return centroids if lists > 1 else sample.mean(axis=0, keepdims=True)


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and all distances."""
    square = (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ centroids.T + (centroids**2).sum(axis=1)
    away = np.sqrt(np.maximum(square, 0))
    return away.argmin(axis=1), away


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _by_dim(df: DataFrame, schema: str, make: Callable[[int, np.ndarray, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``make(dim, vectors, rows)`` over the rows (``vector, dim``) of each batch and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                v = np.array(own.column(own.schema.get_field_index("vector")).flatten(), np.float64).reshape(own.num_rows, dim)
                yield make(dim, v, own)

    return df.mapInArrow(run, schema)


def _packed(rows: DataFrame, centroids: dict[int, np.ndarray] | None) -> DataFrame:
    """Blocks of rows ``cid, low, vector, dim, list, block, tau``, with codes if centroids are given."""

    def run(t: pa.Table) -> pa.Table:
        dim, at, block = (t[c][0].as_py() for c in ("dim", "list", "block"))
        ids, lows, limits = (t[c].to_numpy() for c in ("cid", "low", "tau"))
        v = np.array(t["vector"].combine_chunks().flatten(), np.float64).reshape(len(ids), dim)
        codes, scalars = encode(v, centroids[dim][at] if dim in centroids else np.zeros(dim)) if centroids is not None else (np.empty(0, np.uint8), np.empty(0, np.float32))
        return pa.table({"dim": pa.array([dim], pa.int32()), "list": pa.array([at], pa.int32()), "block": pa.array([block], pa.int32()), "ids": [ids.tobytes()], "lows": [lows.tobytes()], "vectors": [v.tobytes()], "codes": [codes.tobytes()], "scalars": [scalars.tobytes()], "limits": [limits.astype(np.float64).tobytes()]})

    return rows.groupBy("dim", "list", "block").applyInArrow(run, PACKED)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``block``, and ``blocks``: a list's rows in blocks of about ``size``; there are at most ``LISTS`` lists a dimension."""
    sizes = rows.groupBy("dim", "list").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    return rows.join(F.broadcast(sizes), ["dim", "list"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))


def _scan(index: DataFrame, asked: DataFrame, centroids: dict[int, np.ndarray], k: int) -> DataFrame:
    """``query, near, low, score``: of each list that a row of ``asked`` names, the ``k`` nearest classes of each block.

    ``index`` holds packed blocks and how many their list has, ``blocks``; ``asked``: ``cid, low, vector, dim, list, tau``.
    """
    dealt = _dealt(asked, QUERIES)
    parts = dealt.groupBy("dim", "list").agg(F.max("blocks").alias("parts"))
    shape = index.groupBy("dim", "list").agg(F.max("blocks").alias("blocks"))
    left = index.drop("blocks").join(F.broadcast(parts), ["dim", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = _packed(dealt, None).withColumnRenamed("block", "part").join(F.broadcast(shape), ["dim", "list"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(block: pa.Table, ask: pa.Table) -> pa.Table:
        qs, ns, ls, ds = [], [], [], []
        if block.num_rows and ask.num_rows:
            dim, at = block["dim"][0].as_py(), block["list"][0].as_py()

            def read(t: pa.Table, name: str, kind: type, width: int) -> np.ndarray:
                return np.frombuffer(t[name][0].as_py(), kind).reshape(-1, width)

            ids, lows, who = (read(t, name, np.int64, 1)[:, 0] for t, name in ((block, "ids"), (block, "lows"), (ask, "ids")))
            centre = centroids[dim][at] if dim in centroids else np.zeros(dim)
            found = search(read(ask, "vectors", np.float64, dim), read(block, "vectors", np.float64, dim), read(block, "codes", np.uint8, -(-dim // 8)), read(block, "scalars", np.float32, 2), lows, centre, k, read(ask, "limits", np.float64, 1)[:, 0])
            for q, (near, distance) in zip(who, found, strict=True):
                qs.append(np.full(len(near), q))
                ns.append(ids[near])
                ls.append(lows[near])
                ds.append(distance)
        none = np.empty(0, np.int64)
        return pa.table({"query": np.concatenate([none, *qs]), "near": np.concatenate([none, *ns]), "low": np.concatenate([none, *ls]), "score": np.concatenate([np.empty(0), *ds])})

    left = left.select(*[x.split()[0] for x in PACKED.split(", ")], "part")
    right = right.select(*[x.split()[0] for x in PACKED.split(", ")], "part")
    found = left.groupBy("dim", "list", "block", "part").cogroup(right.groupBy("dim", "list", "block", "part")).applyInArrow(run, "query long, near long, low long, score double")
    best = Window.partitionBy("query").orderBy("score", "low")
    return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` nearest other rows of ``vec_id, embedding``."""
    scratch = Scratch(arrow_session(rows))
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    all_ = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    key = F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))
    keyed = scratch.save(all_.withColumn("key", key).withColumn("dim", F.size("vector")), "vectors")
    # Equal vectors: the k + 1 least ids stand for all, since a query leaves out itself only.
    order = Window.partitionBy("key").orderBy("vec_id")
    members = keyed.select("key", "vec_id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    members = scratch.save(members, "members")
    classes = scratch.save(members.where("rn = 1").select("key", F.xxhash64("key").alias("cid"), F.col("vec_id").alias("low")), "classes")
    reps = keyed.join(classes, [keyed["key"] == classes["key"], keyed["vec_id"] == classes["low"]]).select("cid", "low", keyed["key"].alias("key"), "vector", "dim")
    reps = scratch.save(reps.dropDuplicates(["cid"]), "reps")
    asked = keyed.where("is_query").select("key", F.col("vec_id").alias("query_id"))
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample: dict[int, list] = {}
    for r in reps.select("dim", "vector", "cid").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["vector"])
    centroids = {dim: fit_centroids(np.array(v), min(LISTS, -(-sizes[dim] // BLOCK))) for dim, v in sample.items()}

    def deal(dim: int, v: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        own, away = nearest_centroid(v, centroids.get(dim, np.zeros((1, dim))))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(own, pa.int32()), pa.array(away[np.arange(len(own)), own])], names=[*rows.schema.names, "list", "away"])

    rows_ = reps.select("cid", "low", "key", "vector", "dim")
    listed = scratch.save(_by_dim(rows_, "cid long, low long, key string, vector array<double>, dim int, list int, away double", deal), "listed")
    radius = {(r["dim"], r["list"]): r["r"] for r in listed.groupBy("dim", "list").agg(F.max("away").alias("r")).collect()}
    dealt = _dealt(listed.withColumn("tau", F.lit(0.0)), BLOCK)
    blocks = listed.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    index = scratch.save(_packed(dealt, centroids).join(F.broadcast(blocks), ["dim", "list"]), "index")
    infinite = F.lit(float("inf"))
    own = scratch.save(listed.join(asked.select("key").distinct(), "key", "left_semi").select("cid", "low", "vector", "dim", "list", infinite.alias("tau")), "asked")
    first = scratch.save(_scan(index, own, centroids, k + 1), "found")
    reach = first.groupBy("query").agg(F.max("score").alias("worst"), F.count("*").alias("n")).select(F.col("query").alias("cid"), F.when(F.col("n") > k, F.col("worst")).otherwise(infinite).alias("within"))
    others = own.select("cid", "low", "vector", "dim", F.col("list").alias("home")).join(reach, "cid", "left").withColumn("within", F.coalesce("within", infinite))

    def spread_out(dim: int, v: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each further list that can hold something within reach."""
        names = rows.schema.names
        home, within = (rows.column(names.index(c)).to_numpy() for c in ("home", "within"))
        away = nearest_centroid(v, centroids.get(dim, np.zeros((1, dim))))[1]
        wide = np.array([radius.get((dim, j), -np.inf) for j in range(away.shape[1])])
        wanted = (away - wide <= within[:, None] * (1 + 1e-9) + 1e-9) & (wide > -np.inf)
        wanted[np.arange(len(home)), home] = False
        row, at = np.nonzero(wanted)
        taken = rows.take(pa.array(row))
        return pa.RecordBatch.from_arrays([*[taken.column(names.index(c)) for c in ("cid", "low", "vector", "dim")], pa.array(at, pa.int32()), pa.array(within[row])], names=["cid", "low", "vector", "dim", "list", "tau"])

    further = scratch.save(_by_dim(others, "cid long, low long, vector array<double>, dim int, list int, tau double", spread_out), "further")
    found = first
    if not further.isEmpty():
        best = Window.partitionBy("query").orderBy("score", "low")
        found = first.union(_scan(index, further, centroids, k + 1)).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn")
    # From classes to ids, k + 1 a class of queries, and from there to the query rows.
    ids = classes.join(members.select("key", "vec_id"), "key").select(F.col("cid").alias("near"), "vec_id")
    top = Window.partitionBy("query").orderBy("score", "vec_id")
    spread = found.join(ids, "near").withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k + 1).select("query", "vec_id", "score")
    answers = asked.join(classes, "key").select("query_id", F.col("cid").alias("query")).join(spread, "query").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op10_sql() -> str:
    """DuckDB SQL for ``op10_ann``: every query against every other vector."""
    return """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_transform(list_zip(q.v, c.v), lambda p: [p[1], p[2]])], lambda a, b: a + b)) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
