"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces go, longest first, into the open sequence that meets every constraint and scores
best: by the weighted norm of what would stay free of each, or by the weighted dot product of the
piece with what is free. A piece that fits nowhere opens a sequence.

By default a sequence of ``capacity`` tokens takes ``capacity`` documents and a cost of ``capacity``
squared. A single full piece needs that cost, so no tighter limit could place every piece; and no
limit costs a sequence, while all three residuals choose it. Callers can set tighter limits of
documents, looser ones of cost, or None for none.

The pieces are dealt into groups of about ``GROUP`` by where they are in the table of pieces, and
every group is packed by one task; a group leaves only its last few sequences part-filled. Long texts
are cut into full pieces and one rest.

Inputs and edge cases: a null text counts as empty (its piece holds only the end id); a null id stays
null, and ids of any size stay exact; repeated rows give repeated pieces (in any order), dealt to all
groups; equal pieces are placed in the order of id, null last, and piece; an empty table gives an
empty one; only ``doc_id`` and ``text`` are read, so further columns may bear any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load_library, text_of
from .common import Scratch, map_arrow, table

#: Pieces packed by one task.
GROUP = 20_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of ``size``; ``with_ids`` also returns the ids."""
    names = NAMES + ["ids"] * with_ids

    def make():
        bpe, end = load_library(vocabulary), int(end_id).to_bytes(4, "little")

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = bpe.pack(text_of(raw)) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<i4") for p in cols[5]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        return fn

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), PIECE + ", ids array<int>" * with_ids, make)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int | None = None, max_cost: int | None = None, score: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, given longest first.

    Open sequences are rows of a residual matrix, one column a constraint that is set; those too
    short for the shortest length still to come are taken out of it.
    """
    n = len(lengths)
    sizes = [lengths.astype(np.float64)]
    caps = [float(capacity)]
    scale = [weights[0]]
    for cap, item, w in ((max_docs, np.ones(n), weights[1]), (max_cost, lengths.astype(np.float64) ** 2, weights[2])):
        if cap is not None:
            sizes.append(item)
            caps.append(float(cap))
            scale.append(w)
    need, limit, w = np.array(sizes) / np.array(caps)[:, None], len(caps), np.array(scale)[:, None]
    fits = (lengths <= capacity) & (need <= 1).all(axis=0)
    if not fits.all():
        raise ValueError("a piece is beyond the capacity of an empty sequence")
    free = np.empty((limit, 1024))
    left = np.empty(1024, np.int64)
    names = np.empty(1024, np.int64)
    opened, bins = 0, 0
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    shortest = int(lengths[-1]) if n else 0
    eps = 1e-12
    for i, size in enumerate(lengths.tolist()):
        item = need[:, i : i + 1]
        at = -1
        if size < capacity and opened:
            room = free[:, :opened]
            ok = left[:opened] >= size
            for d in range(1, limit):
                ok &= room[d] + eps >= item[d]
            where = np.flatnonzero(ok)
            if len(where):
                room = room[:, where]
                value = -(w * (room - item) ** 2).sum(axis=0) if score == "norm" else (w * room * item).sum(axis=0)
                at = int(where[value.argmax()])
        if at < 0:
            seq[i], offset[i] = bins, 0
            bins += 1
            if capacity - size < shortest:
                continue
            if opened == free.shape[1]:
                free = np.concatenate([free, np.empty_like(free)], axis=1)
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            at = opened
            opened += 1
            free[:, at], left[at], names[at] = 1.0, capacity, bins - 1
        seq[i], offset[i] = names[at], capacity - left[at]
        left[at] -= size
        free[:, at] -= item[:, 0]
        if left[at] < shortest:
            opened -= 1
            free[:, at], left[at], names[at] = free[:, opened], left[opened], names[opened]
    return seq, offset


def _limits(capacity: int, max_docs: int | None | str, max_cost: int | None | str) -> dict[str, int | None]:
    return {"max_docs": capacity if max_docs == "capacity" else max_docs, "max_cost": capacity**2 if max_cost == "capacity" else max_cost}


def pack(items: DataFrame, capacity: int, count: int, max_docs: int | None | str = "capacity", max_cost: int | None | str = "capacity", score: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``items`` (``PIECE`` columns and ``row``, any numbers that differ) with ``sequence_id`` and ``offset``; ``count``: their number.

    ``max_docs`` and ``max_cost``: the defaults of the module, or numbers, or None for no limit.
    """
    groups = max(1, -(-count // GROUP))
    limits = _limits(capacity, max_docs, max_cost)

    def run(t: pa.Table) -> pa.Table:
        group = t["_group"][0].as_py()
        t = t.select(NAMES).take(pc.sort_indices(t, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")], null_placement="at_end"))
        seq, offset = best_fit(t["length"].to_numpy(), capacity, score=score, weights=weights, **limits)
        return t.append_column("sequence_id", pa.array((group << 32) + seq)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("row"), F.lit(groups))
    return items.select(*NAMES, group.alias("_group")).groupBy("_group").applyInArrow(run, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, **limits) -> DataFrame:
    """Pieces of all texts with their place in sequences of at most ``capacity`` tokens."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(cut, capacity, cut.count(), **limits)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, 2048 documents and a cost of 2048 squared."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
