"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence has the probability sigmoid(bias + sum of the weights of its distinct words and stems); a document is
toxic unless every sentence is harmless and a small leak does not strike (noisy-or):
1 - (1 - leak) * product(1 - p). The weights are learnt from document labels by gradient descent on
this likelihood; the bias stays so low that thousands of neutral sentences do not add up. A word or stem
has a weight if toxic documents hold it more often than chance, by a log likelihood ratio above ``GAIN``,
copies of a document counting once; a word that no harmless one holds needs about eight toxic
documents if a ninth of all are toxic. The vocabulary has no other bound. The sentences of
probability 0.5 or more are reported with their place in the text.

Learning takes at most ``SAMPLE`` labelled documents of at most ``LONGEST`` characters, as they come by hash:
with toxic ones preferred, held-out precision fell, as too few harmless ones were left to learn from.

Inputs and edge cases: a null or empty text scores the leak alone; texts are read whole; repeated rows
score alike; an empty table gives an empty one; without labels the score is the leak; a document has one
vote, contradicting labels count as the more frequent one, ties as toxic, and labels other than 0 and 1 are
passed over; a null id is scored and never learnt from; only ``doc_id`` and ``text`` are read, so further
columns may bear any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, table

#: Labelled documents to learn from, at most (those of the least hash), and their longest texts in characters.
SAMPLE, LONGEST = 8_000, 50_000
#: A word is used from this log likelihood ratio on.
GAIN = 16.0
BIAS, RIDGE, STEPS, RATE = -12.0, 1e-4, 300, 2.0
#: Weight that a word starts with; harmless documents take it away.
START = 14.0
#: Besides the word, its beginnings of these lengths are features (stems of inflected words).
STEMS = (4, 5, 6, 7)
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(text: str) -> set[str]:
    """The distinct lower-case words of a text and their stems."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


def least_sentence(text: str) -> int:
    """The least hash of a text's sentences, which copies with few changes mostly share."""
    return min((zlib.crc32(x.strip().encode("utf-8", "replace")) for x in SENTENCE.findall(text)), default=0)


class NoisyOr:
    """The fitted model: word weights and the leak."""

    def __init__(self, weights: dict[str, float], leak: float) -> None:
        self.weights, self.leak = weights, leak

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """``(start, end, probability)`` of the sentences that hold a word of the model; others are neutral."""
        weights, out = self.weights, []
        for m in SENTENCE.finditer(text):
            known = features(m[0]) & weights.keys()
            if known:
                z = BIAS + sum(weights[w] for w in sorted(known))
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        # Lower-casing never joins or splits words, so a text without a known word has no such sentence.
        found = self.spans(text) if not self.weights.keys().isdisjoint(features(text)) else []
        safe = 1 - self.leak
        for _, _, p in found:
            safe *= 1 - p
        return 1 - safe, found


def fit(texts: list[str], toxic: list[int]) -> NoisyOr:
    """Learn from document labels."""
    y = np.array(toxic, np.float64)
    n, positives = len(y), float(y.sum())
    if not positives or positives == n:
        return NoisyOr({}, min(max(positives / n if n else 0.0, 0.0), 0.4))
    # Evidence counts groups of like documents: copies, however many, say the same thing once.
    groups: dict[tuple[int, int], list[str]] = {}
    for t, label in zip(texts, toxic, strict=True):
        groups.setdefault((label, least_sentence(t)), []).append(t)
    hits, seen = Counter(), Counter()
    for (label, _), own in groups.items():
        if label:
            hits.update(set().union(*map(features, own)))
    for (label, _), own in groups.items():
        if not label:
            seen.update(set().union(*map(features, own)) & hits.keys())
    # Words that toxic documents hold more often than chance, by the likelihood ratio.
    rate, gain = sum(label for label, _ in groups) / len(groups), {}
    for w, k in hits.items():
        d = k + seen[w]
        if k / d > rate:
            gain[w] = k * math.log(k / d / rate) + ((d - k) * math.log((d - k) / d / (1 - rate)) if d > k else 0.0)
    chosen = sorted((w for w in gain if gain[w] > GAIN), key=lambda w: (-gain[w], w))
    index = {w: i for i, w in enumerate(chosen)}
    doc, sent, word, count = [], [], [], 0
    for d, t in enumerate(texts):
        for s in SENTENCE.findall(t):
            known = sorted(index[w] for w in features(s) & index.keys())
            if known:
                sent += [count] * len(known)
                word += known
                doc.append(d)
                count += 1
    doc_, sent_, word_ = np.array(doc, np.int64), np.array(sent, np.int64), np.array(word, np.int64)
    w, spread = np.full(len(chosen), START), np.maximum(np.bincount(word_, minlength=len(chosen)), 1.0)
    leak = 0.02
    for _ in range(STEPS):
        z = BIAS + np.bincount(sent_, w[word_], count)
        p = 1 / (1 + np.exp(-z))
        safe = np.bincount(doc_, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        odd = 1 - (1 - leak) * np.exp(safe)
        blame = np.where(y > 0, -(1 - odd) / np.maximum(odd, 1e-9), 1.0)
        slope = np.bincount(word_, (blame[doc_] * p)[sent_], len(chosen))
        w = w - RATE * (slope / spread + RIDGE * w)
        # The leak's share of the toxic documents that the sentences leave unexplained.
        own = (y * leak / np.maximum(odd, 1e-9)).sum()
        leak = float(np.clip(own / max(1.0, (1 - y).sum() + own), 1e-4, 0.4))
    return NoisyOr({t: float(x) for t, x in zip(chosen, w, strict=True) if abs(x) > 0.05}, leak)


def learn(docs: DataFrame, labels: DataFrame) -> NoisyOr:
    """Fit on at most ``SAMPLE`` labelled documents that are not held out (crc32 of the id, modulo 5, is not 0)."""
    toxic = F.col("toxic").cast("int")
    known = labels.where(toxic.isin(0, 1) & F.col("doc_id").isNotNull()).where(crc_mod("doc_id", 5) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(toxic) >= 0.5).cast("int").alias("toxic"))
    # SAMPLE rows of two numbers: small enough to broadcast at any size of the input.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)
    rows = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] or "" for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``doc_id, score`` and ``spans``: the offending sentences ``(start, end, score)`` in characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            both = [model.score((x or b"").decode("utf-8", "replace")) for x in b.column(1).to_pylist()]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in found if p >= 0.5] for _, found in both]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in both], pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "spans"])

        return fn

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary")), f"doc_id {kind}, score double, spans array<struct<start:int,end:int,score:double>>", make)


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of a score below 0.5, with all their columns."""
    model = learn(docs, labels)

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array([model.score(x or "")[0] < 0.5 for x in b.column("text").to_pylist()], pa.bool_()))

        return fn

    return map_arrow(docs, docs.schema, make)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
