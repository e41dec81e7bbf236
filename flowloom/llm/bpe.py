"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols lie in a linked list; leaf ``i`` of the tree holds the rank of the pair that
starts at symbol ``i``. The root is the leftmost pair of lowest rank. A merge rewrites at most
three leaves, each in logarithmic time, and merging ends when the root holds no pair.

Inputs and edge cases: a null text counts as empty and has no ids; any length is encoded whole;
repeated rows give repeated results; an empty table gives an empty one; only the named columns
are read, so further columns may bear any name. The vocabulary file is a parameter.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

NO_PAIR = 1 << 62
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (chr(256 + k) for k in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class PairTree:
    """Segment tree of ``rank * 2**32 + position`` over the adjacent pairs of one word."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = size = 1 << max(0, len(leaves) - 1).bit_length()
        self.node = node = [NO_PAIR] * size + leaves + [NO_PAIR] * (size - len(leaves))
        for k in range(size - 1, 0, -1):
            a, b = node[2 * k], node[2 * k + 1]
            node[k] = a if a < b else b

    def root(self) -> int:
        return self.node[1]

    def put(self, leaf: int, value: int) -> None:
        node, k = self.node, self.size + leaf
        node[k] = value
        while k > 1:
            a, b = node[k], node[k ^ 1]
            k >>= 1
            best = a if a < b else b
            if node[k] == best:
                break
            node[k] = best


class WordBPE:
    """A lower-casing word-end BPE vocabulary, read from a tokenizers JSON file."""

    #: Words of a cache generation (two are held), and the longest word kept.
    WORDS, LONG = 300_000, 64

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.inner = [vocab[c] for c in byte_alphabet()]
        self.last = [vocab[c + WORD_END] for c in byte_alphabet()]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Tokens by id; the last stands for ids that there are not.
        self.names = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 2)], object)
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by repeated merging of the tree's root."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n, pairs = len(ids), self.pairs
        if n == 1:
            return ids

        def leaf(i: int, j: int) -> int:
            hit = pairs.get((ids[i], ids[j]))
            return NO_PAIR if hit is None else (hit[0] << 32) | i

        tree = PairTree([leaf(i, i + 1) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree.root()) != NO_PAIR:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, NO_PAIR)
            if k < n:
                before[k] = i
                tree.put(i, leaf(i, k))
            else:
                tree.put(i, NO_PAIR)
            if (h := before[i]) >= 0:
                tree.put(h, leaf(h, i))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = self.merge(word.encode("utf-8", "surrogatepass"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= self.LONG:
            if len(self.seen) >= self.WORDS:
                self.old, self.seen = self.seen, {}
            self.seen[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        get, word = self.seen.get, self._word
        return b"".join([get(w) or word(w) for w in SPLIT.findall(text)])

    def pack(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None:
            return self._plain(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._plain(p) for p in self.cut.split(text) if p)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: tokens, special ones too, joined by a space; unknown ids give nothing."""
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of many lists of ids that lie one after another."""
        known = self.names[np.where((ids >= 0) & (ids < len(self.names)), ids, len(self.names) - 1)]
        return [" ".join(filter(None, known[a:b].tolist())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


class LibraryBPE(WordBPE):
    """The same ids with each new word merged by the tokenizers library, for operators that only need ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model, self.alphabet = Tokenizer.from_file(path).model, byte_alphabet()

    def merge(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join([self.alphabet[b] for b in word]))]


@lru_cache(maxsize=2)
def load_library(path: str) -> LibraryBPE:
    return LibraryBPE(path)


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """One vocabulary a Python worker, with its word cache, whatever the number of tasks."""
    return WordBPE(path)


def text_of(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        bpe = load(vocabulary)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            packed = [bpe.pack(text_of(x)) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int64).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            return pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

        return fn

    return map_arrow(docs.select(id_col, F.col(text_col).cast("binary").alias("_t")), f"`{id_col}` {kind}, ids array<int>", make)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded string`` of each row's ids; null ids count as none."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def make():
        bpe = load(vocabulary)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
            texts = bpe.decode_all(flat, np.concatenate([[0], np.cumsum(sizes)]))
            return pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

        return fn

    return map_arrow(encoded.select(id_col, "ids"), f"`{id_col}` {kind}, ids array<int>, decoded string", make)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of all documents."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
