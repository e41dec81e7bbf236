"""Training, calibration and scoring of flow classifiers with MLlib.

Rows have the feature columns, ``y`` (0 or 1) and ``capture``; folds are made of whole captures. Extra trees
and histogram boosting have no MLlib form: random forests and gradient-boosted trees stand in for them.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Iterator

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators import metrics
from flowloom.operators.splits import group_folds

#: Feature groups of the ablation, each added to those before it; together all 66 features.
GROUPS = {
    "B_rate_statistical": (
        "flow_bytes_s", "flow_packets_s", "avg_pkt_size", "avg_fwd_seg", "avg_bwd_seg", "down_up_ratio",
        "pkt_len_max", "pkt_len_min", "pkt_len_mean", "pkt_len_std", "flow_duration_s",
    ),
    "C_directional": (
        "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_len_max", "fwd_len_min", "fwd_len_mean", "fwd_len_std",
        "bwd_len_max", "bwd_len_min", "bwd_len_mean", "bwd_len_std", "fwd_header_bytes", "bwd_header_bytes", "fwd_data_pkts", "bwd_data_pkts",
    ),
    "D_timing_iat": (
        "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min", "fwd_iat_total", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min",
        "bwd_iat_total", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max", "bwd_iat_min", "active_mean", "active_std", "active_max", "active_min",
        "idle_mean", "idle_std", "idle_max", "idle_min",
    ),
    "E_tcp_behavior": (
        "fin_count", "syn_count", "rst_count", "psh_count", "ack_count", "urg_count", "ece_count", "cwr_count", "fwd_psh", "bwd_psh", "fwd_urg", "bwd_urg",
        "init_fwd_win", "init_bwd_win", "fwd_win_mean", "bwd_win_mean",
    ),
    "F_protocol_indicator": ("protocol",),
}
#: The search space of tree ensembles, in MLlib's names. No depth limit is MLlib's deepest; class weights are row weights.
SPACE = {
    "numTrees": (100, 200, 300, 500),
    "maxDepth": (30, 12, 20, 28),
    "minInstancesPerNode": (1, 2, 5, 10),
    "featureSubsetStrategy": ("sqrt", "0.3", "0.5", "0.75"),
    "balanced": (True, False),
    "impurity": ("gini", "entropy"),
}


def staircase() -> Iterator[tuple[str, list[str]]]:
    """Cumulative feature sets."""
    cols: list[str] = []
    for name, group in GROUPS.items():
        cols += group
        yield name, list(cols)


def pipeline(kind: str, features: list[str], seed: int = 42, **params) -> Pipeline:
    """``lr``, ``rf`` or ``gbt`` over assembled features; rows are weighted by ``weight``."""
    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    if kind == "lr":
        scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
        return Pipeline(stages=[assemble, scale, LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", **params)])
    model = {"rf": RandomForestClassifier, "gbt": GBTClassifier}[kind]
    return Pipeline(stages=[assemble, model(labelCol="y", weightCol="weight", seed=seed, **params)])


def weighted(rows: DataFrame, balanced: bool = True) -> DataFrame:
    """Rows with balanced class weights, or all of weight 1; the join's other side has one row a class."""
    if not balanced:
        return rows.withColumn("weight", F.lit(1.0))
    return rows.join(F.broadcast(metrics.class_weights(rows).select("y", "weight")), "y")


def scored(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).withColumn("p", p).withColumn("pred", (F.col("p") >= threshold).cast("int")).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def fold_column(captures: DataFrame, n_splits: int, seed: int = 42) -> Column:
    """The fold of a row's capture."""
    folds = group_folds(captures, n_splits, seed)
    return F.create_map(*[F.lit(x) for kv in folds.items() for x in kv])[F.col("capture")]


def trials(n: int, seed: int = 42) -> list[dict]:
    """``n`` different random points of the search space."""
    every = [dict(zip(SPACE, v, strict=True)) for v in itertools.product(*SPACE.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def search(rows: DataFrame, features: list[str], n_trials: int = 10, n_splits: int = 3, seed: int = 42, done: frozenset[str] = frozenset()) -> Iterator[dict]:
    """One record a trial, with metrics over the folds; ``done`` names trials of earlier runs."""
    captures = rows.groupBy("capture").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    data = rows.withColumn("fold", fold_column(captures, n_splits, seed)).cache()
    for params in trials(n_trials, seed):
        name = ",".join(f"{k}={v}" for k, v in sorted(params.items()))
        if name in done:
            continue
        folds = []
        for k in range(n_splits):
            own = {p: v for p, v in params.items() if p != "balanced"}
            model = pipeline("rf", features, seed, **own).fit(weighted(data.where(F.col("fold") != k), params.get("balanced", True)))
            out = scored(model, data.where(F.col("fold") == k)).withColumn("p", F.round("p", 4))
            folds.append(metrics.confusion(out).crossJoin(F.broadcast(metrics.average_precision_auc(out))).first().asDict())
        means = {f"mean_{m}": sum(f[m] or 0.0 for f in folds) / len(folds) for m in ("precision", "recall", "f1", "fpr", "fnr", "average_precision", "roc_auc")}
        yield {"trial": name, **means, "worst_fold_recall": min(f["recall"] for f in folds)}
    data.unpersist()


class Calibrated:
    """A fitted calibration: ``transform`` gives rows the column ``p_cal`` by the fitted model itself."""

    def __init__(self, kind: str, model) -> None:
        self.kind, self.model = kind, model

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.kind == "sigmoid":
            z = F.col("p") * float(self.model.coefficients[0]) + float(self.model.intercept)
            return rows.withColumn("p_cal", 1 / (1 + F.exp(-z)))
        out = self.model.setFeaturesCol("p").setPredictionCol("p_cal").transform(rows)
        return out.withColumn("p_cal", F.col("p_cal").cast("double"))


def calibrate(held_out: DataFrame, method: str = "auto") -> Calibrated:
    """Fits probabilities on ``p, y`` of held-out rows.

    ``auto`` takes isotonic regression, or a sigmoid if there are at most ten different outputs.
    """
    if method == "auto":
        method = "sigmoid" if held_out.select("p").distinct().limit(11).count() <= 10 else "isotonic"
    rows = held_out.select("p", F.col("y").cast("double").alias("y"))
    if method == "sigmoid":
        vectors = VectorAssembler(inputCols=["p"], outputCol="x").transform(rows)
        return Calibrated(method, LogisticRegression(featuresCol="x", labelCol="y").fit(vectors))
    return Calibrated(method, IsotonicRegression(featuresCol="p", labelCol="y").fit(rows))


def timed(action, *args):
    """The result of a call and its seconds."""
    began = time.perf_counter()
    return action(*args), time.perf_counter() - began


def train_and_test(rows: DataFrame, features: list[str], test_captures: list[str], kind: str = "rf", target_fpr: float = 0.01, seed: int = 42, **params) -> tuple[PipelineModel, Calibrated, dict]:
    """The whole job over a flow table: fit on half of the development captures, calibrate and choose the
    operating point on the others, and test once on ``test_captures``.

    ``rows``: the features, ``y`` and ``capture``. The record has the test's metrics at the operating point and
    the seconds of training and scoring, with flows a second.
    """
    test = F.col("capture").isin(test_captures)
    captures = rows.where(~test).groupBy("capture").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    dev = rows.where(~test).withColumn("fold", fold_column(captures, 2, seed))
    model, fit_s = timed(pipeline(kind, features, seed, **params).fit, weighted(dev.where("fold = 0").drop("fold")))
    held = scored(model, dev.where("fold = 1").drop("fold"))
    fitted = calibrate(held)
    calibrated = fitted.transform(held).withColumn("p", F.col("p_cal"))
    point = metrics.operating_point(calibrated, target_fpr).first()["threshold"]
    point = 0.5 if point is None else point
    out = fitted.transform(scored(model, rows.where(test))).withColumn("p", F.col("p_cal")).withColumn("pred", (F.col("p") >= point).cast("int"))
    n, score_s = timed(lambda: out.agg(F.count("p")).first()[0])
    record = metrics.confusion(out).crossJoin(F.broadcast(metrics.average_precision_auc(out))).first().asDict()  # one row each
    return model, fitted, record | {"threshold": point, "calibration": fitted.kind, "train_s": fit_s, "infer_s": score_s, "flows_a_second": n / max(score_s, 1e-9), "n": n}


def parse_records(texts: DataFrame, features: list[str], column: str = "value") -> DataFrame:
    """JSON flow records by line: the features as doubles, and ``error``: what a record lacks, or null.

    Every feature has to be there, a number and finite; further fields are passed over.
    """
    kinds = F.from_json(column, "map<string,string>")
    out = texts.withColumn("_r", kinds)
    number = {c: F.col("_r")[c].try_cast("double") for c in features}
    wrong = F.filter(F.array(*[F.when(number[c].isNull() | F.isnan(number[c]) | (F.abs(number[c]) == float("inf")), F.lit(c)) for c in features]), lambda x: x.isNotNull())
    error = F.when(F.col("_r").isNull(), "no JSON record").when(F.size(wrong) > 0, F.concat(F.lit("missing or not finite: "), F.array_join(wrong, ", ")))
    return out.select(*[c for c in texts.columns], *[number[c].alias(c) for c in features], error.alias("error"))


def invalid_records(rows: DataFrame, features: list[str]) -> DataFrame:
    """Records that cannot be scored: a feature is missing, not a number or not finite."""
    from flowloom.operators.audit import finite

    return rows.where(~F.coalesce(finite(features), F.lit(False)))
