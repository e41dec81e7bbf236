"""Quality rules whose cutoffs are chosen under a bound on false rejection in every stratum.

Every rule is a ratio that grows with junk, with a ladder of cutoffs fixed beforehand, lenient first.
The labelled documents are dealt by hash of their id:

* One part (a third) orders the cutoffs of all rules into one path in each stratum (a language): step by
  step, the rule that catches most further junk, less a weight for good documents, is tightened.
  So what the path rejects only grows along it.
* The other part is the holdout. The share of good documents of the stratum that the rules together
  reject up to a step is tested against ``ALLOWED`` with the exact binomial tail, which is the
  Clopper-Pearson bound read as a test. Along the path the tests are a fixed sequence that ends at
  the first failure, so they need no correction; over the strata the level is divided (Bonferroni).
  So with probability 1 - ``RISK``, no stratum loses more than ``ALLOWED`` of its good documents. Of the
  steps that pass, the one that rejects most junk of the stratum, less the weight, is used.

A stratum of so few good labels that not even a step without a false rejection could pass (59 for one
stratum, 86 for four) is certified nothing, so only the base rules reject there. This is what the bound
needs and no switch by size: every stratum takes the same test, whatever their number. A stratum is
fitted by one task from the counts of its label vectors, of which there are at most
4 * (steps of the ladder + 1) ** rules, however many labels there are.

Inputs and edge cases: a null text counts as empty and has no words; texts are read whole; repeated
rows are judged alike; an empty table gives an empty one; a null language is the stratum of the empty
name; without labels, no rule is used; a document has one vote however often it is labelled or
repeated: contradicting labels count as the more frequent one, ties as good, and of rows that share
an id the most junk-like counts; only ``doc_id``, ``text`` and ``lang`` are read, so further columns may bear any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, map_arrow, mix64, table

#: Share of good documents that the rules together may reject in a stratum; probability that one is exceeded.
ALLOWED, RISK = 0.05, 0.05
#: Labelled junk that a rejected good document must outweigh.
GOOD_WEIGHT = 3
#: The path is learnt from one of so many parts of the labelled documents.
PARTS = 3
SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
WINDOW = 8
LADDER = [round(0.9 * 0.8**k, 4) for k in range(18)]
#: Rules by the feature column they read; the cutoffs are the same ladder times a scale.
RULES = {
    "symbol_ratio": 1.0,
    "upper_ratio": 1.0,
    "bang_ratio": 1.0,
    "dup_line_ratio": 1.0,
    "repeat_ratio": 1.0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{r} double" for r in RULES)
WORDS = WordHashes()


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j])
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    step = np.zeros(len(words) + 1, np.int64)
    found = np.flatnonzero(twice[at] == h)
    step[found] += 1
    np.subtract.at(step, found + WINDOW, 1)
    return int((step[:-1].cumsum() > 0).sum())


def features(text: bytes) -> tuple:
    """Counts and rule ratios of one text."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, UPPER))
    return (n, chars, symbols, dup, repeats, symbols / max(chars, 1), upper / max(letters, 1), min(1.0, text.count(b"!") / max(n, 1)), dup / max(len(lines), 1), repeats / max(n, 1))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` and the features of every whole text."""
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RULES)
    names = ["doc_id", "lang", *COUNTS, *RULES]

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = zip(*(features(x or b"") for x in b.column(2).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

        return fn

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("binary")), f"doc_id long, lang string, {FEATURES}", make)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))])
    top = logs.max()
    return min(1.0, math.exp(top + math.log(np.exp(logs - top).sum())))


def upper_bound(k: int, n: int, level: float) -> float:
    """The Clopper-Pearson upper bound of a share of which ``k`` in ``n`` were seen."""
    low, high = k / n if n else 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if 0 < middle < 1 and binomial_tail(k, n, middle) > level else (low, middle)
    return high if k < n else 1.0


def learn_path(first: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """The path as ``(rule, step of its ladder)``.

    ``first`` has by rule the first step that rejects a document; ``good`` and ``bad`` count documents of each row.
    """
    now, path = [-1] * len(RULES), []
    while True:
        best = (0, 1, 0)
        for r in range(len(RULES)):
            gain = np.bincount(first[:, r], bad - GOOD_WEIGHT * good, len(LADDER) + 1).cumsum()
            for k in range(now[r] + 1, len(LADDER)):
                best = max(best, (int(gain[k]), -k, -r))
        if best[0] <= 0:
            return path
        r, k = -best[2], -best[1]
        # The cutoffs between reject more on their way; each that does is a step to certify.
        path += [(r, j) for j in range(now[r] + 1, k + 1) if j == k or (first[:, r] == j).any()]
        now[r] = k
        left = first[:, r] > k
        first, good, bad = first[left], good[left], bad[left]


def certified(good: np.ndarray, bad: np.ndarray, level: float, allowed: float = ALLOWED) -> tuple[int, int]:
    """The last step of the path to use (-1: none) and the last that passed.

    ``good`` and ``bad`` hold how many documents of the holdout each step is the first to reject; the
    last entry counts those that no step rejects.
    """
    best, use, passed = 0, -1, -1
    for k, (g, b) in enumerate(zip(good.cumsum()[:-1].tolist(), bad.cumsum()[:-1].tolist(), strict=True)):
        if binomial_tail(g, int(good.sum()), allowed) > level:
            break
        passed = k
        if b - GOOD_WEIGHT * g > best:
            best, use = b - GOOD_WEIGHT * g, k
    return use, passed


def stratum(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang), F.lit(""))


def votes(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``lang, quality, first, train``: a row a labelled document. ``scored``: output of ``measured``; ``labels``: ``doc_id, quality``."""
    quality = F.col("quality").cast("int")
    one = labels.where(quality.isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(quality) >= 0.5).cast("int").alias("quality"))
    # The first step of the ladder that rejects the document: how many cutoffs it stays within.
    first = F.array(*[sum(((F.col(r) <= c * scale).cast("int") for c in LADDER), F.lit(0)) for r, scale in RULES.items()])
    rows = scored.select("doc_id", stratum().alias("lang"), first.alias("first")).join(one, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("first", "lang", "quality")).alias("v"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS))
    return rows.select("doc_id", "v.lang", "v.quality", "v.first", (part == 0).alias("train"))


def fit(rows: pd.DataFrame, level: float) -> tuple[dict[str, float], int, int, float]:
    """Of one stratum: the cutoffs by rule, the good documents of the holdout, how many the cutoffs reject, and the bound of that share.

    ``rows``: ``train, quality, first, n``.
    """
    first = np.array(rows["first"].tolist(), np.int64).reshape(-1, len(RULES))
    n, train, is_good = (rows[c].to_numpy() for c in ("n", "train", "quality"))
    is_good, train = is_good == 1, train.astype(bool)
    path = learn_path(first[train], np.where(is_good, n, 0)[train], np.where(is_good, 0, n)[train])
    # The first step of the path that rejects a row of the holdout; the path's length if none does.
    at = np.full(len(rows), len(path))
    for k, (r, j) in reversed(list(enumerate(path))):
        at[first[:, r] <= j] = k
    good, bad = (np.bincount(at[which], n[which], len(path) + 1).astype(np.int64) for which in (~train & is_good, ~train & ~is_good))
    use, _ = certified(good, bad, level)
    names, cutoffs = list(RULES), {}
    for r, j in path[: use + 1]:
        cutoffs[names[r]] = LADDER[j] * RULES[names[r]]
    total, lost = int(good.sum()), int(good[: use + 1].sum())
    return cutoffs, total, lost, upper_bound(lost, total, level) if use >= 0 else 0.0


def choose_cutoffs(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Of every labelled stratum ``lang``, a cutoff (or null) for each rule, and ``good, rejected, bound`` as in ``fit``."""
    scratch = Scratch(scored.sparkSession)
    counts = scratch.save(votes(scored, labels).groupBy("lang", "train", "quality", "first").agg(F.count("*").alias("n")), "votes")
    # How many tests could pass at all depends on the number of labels alone, not on what they say.
    least = math.ceil(math.log(RISK) / math.log1p(-ALLOWED))
    sizes = counts.where("quality = 1 and not train").groupBy("lang").agg(F.sum("n").alias("good"))
    level = RISK / max(1, sizes.where(F.col("good") >= least).count())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cutoffs, good, lost, bound = fit(rows, level)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], **{r: pd.Series([cutoffs.get(r)], dtype="float64") for r in RULES}, "good": [good], "rejected": [lost], "bound": [bound]})

    schema = "lang string, " + ", ".join(f"{r} double" for r in RULES) + ", good long, rejected long, bound double"
    out = counts.groupBy("lang").applyInPandas(run, schema)
    # pandas has no null among numbers
    return scratch.save(out.withColumns({r: F.when(~F.isnan(r), F.col(r)) for r in RULES}), "cutoffs")


def base_failed(value=F.col) -> Column:
    return (value("n_words") < 20) | (100 * value("n_repeat_words") > 30 * value("n_words"))


def _judged(scored: DataFrame, cutoffs: DataFrame, lang: Column, value=F.col) -> DataFrame:
    """``scored`` with ``_base`` and ``_kept``."""
    used = cutoffs.select(F.col("lang").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES])
    out = scored.withColumn("_stratum", lang).join(used, "_stratum", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(value(r) > F.col(f"_{r}"), F.lit(False))
    return out.withColumn("_base", base_failed(value)).withColumn("_kept", ~F.col("_base") & ~rejected)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` of every document."""
    scored = Scratch(docs.sparkSession).save(measured(docs), "quality")
    out = _judged(scored, choose_cutoffs(scored, labels), stratum())
    return out.select(*scored.columns, F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    One pass measures the texts and writes them with their features, so no text is measured twice or shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    name = "features"
    while name in docs.columns:
        name += "_"
    kinds = [(c, pa.int64()) for c in COUNTS] + [(r, pa.float64()) for r in RULES]

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = zip(*(features((x or "").encode("utf-8", "replace")) for x in b.column("text").to_pylist()), strict=True)
            found = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])
            return pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

        return fn

    schema = docs.select("*", F.lit(None).cast(f"struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>").alias(name)).schema
    whole = scratch.save(map_arrow(docs, schema, make), "quality")
    scored = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), *[F.col(name)[c].alias(c) for c in (*COUNTS, *RULES)])
    cutoffs = choose_cutoffs(scored, labels)
    rows = whole.select(F.struct(*docs.columns).alias("row"), F.col(name).alias("features"))
    return _judged(rows, cutoffs, F.coalesce(F.col("row")["lang"], F.lit("")), lambda c: F.col("features")[c]).where("_kept").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
