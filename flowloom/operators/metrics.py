"""Evaluation metrics of scored rows ``y`` (0 or 1) and ``p`` (a score), as aggregations.

Curves are computed over distinct scores, so equal scores are one step; running sums need one total
order and are made over the aggregated scores, not the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.ranks import with_running


def ratio(num: Column, den: Column) -> Column:
    """0 where nothing can be divided."""
    return F.when(den > 0, num / den).otherwise(0.0)


def confusion(scored: DataFrame, keys: list[str] | None = None, pred: str = "pred") -> DataFrame:
    """Counts and precision, recall, F1, FPR and FNR, overall or by ``keys``."""
    y, hit = F.col("y") == 1, F.col(pred) == 1
    counts = scored.groupBy(*(keys or [])).agg(
        F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp")
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("fpr", ratio(fp, fp + tn)).withColumn("fnr", ratio(fn, fn + tp))


def curve(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per distinct score, descending: positives and negatives there and so far."""
    at = scored.groupBy(*(keys or []), "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    if not keys:
        total = at.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("all_neg"))
        return with_running(at, "p", {"tp": "pos", "fp": "neg"}).crossJoin(F.broadcast(total))  # one row
    w = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    out = at.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
    return out.withColumn("all_pos", F.sum("pos").over(every)).withColumn("all_neg", F.sum("neg").over(every))


def average_precision_auc(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Step-wise average precision, and ROC-AUC with half ties; null on one class."""
    c = curve(scored, keys)
    ap = F.sum(F.try_divide("pos", "all_pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    auc = F.sum(F.try_divide("neg", "all_neg") * F.try_divide(F.col("tp") - F.col("pos") / 2, F.col("all_pos")))
    return c.groupBy(*(keys or [])).agg(ap.alias("average_precision"), auc.alias("roc_auc"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def calibration_bins(scored: DataFrame, bins: int = 15) -> DataFrame:
    bin_ = F.least(F.greatest(F.floor(F.col("p") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return scored.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def ece(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = calibration_bins(scored, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def threshold_grid(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Metrics at every threshold in one pass: a row is counted in the step between two thresholds.

    Rows are not multiplied by the thresholds; counts per step are, which are few.
    """
    cuts = sorted(thresholds)
    step = sum(((F.col("p") >= t).cast("int") for t in cuts), F.lit(0))
    at = scored.groupBy(step.alias("step")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)]))
    wide = at.withColumn("g", grid).select("step", "pos", "neg", "g.at", "g.threshold")
    over = F.col("step") >= F.col("at")
    counts = wide.groupBy("threshold").agg(
        F.sum(F.when(over, 0).otherwise(F.col("neg"))).alias("tn"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(over, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp")
    )
    out = with_rates(counts)
    return out.withColumn("missed_attacks", F.col("fn")).withColumn("cost_fp_per_1k_benign", 1000 * F.col("fpr"))


def threshold_candidates(scored: DataFrame, fpr_target: float = 0.01) -> DataFrame:
    """Thresholds by the best F1, the best Youden index and the highest recall within a false-positive target."""
    c = curve(scored).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("all_pos"))).withColumn("fpr", ratio(F.col("fp"), F.col("all_neg")))
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("youden", F.col("recall") - F.col("fpr"))

    def best(x: Column) -> Column:
        return F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), F.col("p").alias("p"))))["p"]

    return c.agg(best(F.round("f1", 12)).alias("best_f1"), best(F.round("youden", 12)).alias("best_youden"), F.coalesce(F.min(F.when(F.col("fpr") <= fpr_target, F.col("p"))), F.min("p")).alias("fpr_bound"))


def operating_point(scored: DataFrame, target: float, start: int = 50, stop: int = 98) -> DataFrame:
    """The least threshold start/100, ..., stop/100 whose false-positive rate is within the target."""
    grid = threshold_grid(scored, [k / 100 for k in range(start, stop + 1)])
    return grid.where(F.col("fpr") <= target).agg(F.min("threshold").alias("threshold"))


def group_recall(scored: DataFrame, key: str) -> DataFrame:
    return scored.groupBy(key).agg(F.count("*").alias("n_flows"), F.avg(F.col("pred").cast("double")).alias("recall"), F.avg("p").alias("mean_proba"))


def class_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    """n / (classes * n_class), of each class; a join on ``y`` gives sample weights."""
    counts = rows.groupBy(y).agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))  # one row
    return counts.crossJoin(F.broadcast(all_)).select(y, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def nearest_rank(values: DataFrame, x: str, order: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), last: int = 20_000) -> DataFrame:
    """Nearest-rank percentiles of the latest ``last`` values: the item at round(p * (n - 1)), halves to even."""
    latest = values.select(x, order).orderBy(F.desc(order)).limit(last)
    sorted_ = latest.agg(F.array_sort(F.collect_list(x)).alias("a"))
    return sorted_.select(*[F.element_at("a", (F.bround(p * (F.size("a") - 1), 0) + 1).cast("int")).alias(f"p{round(100 * p)}") for p in shares])
