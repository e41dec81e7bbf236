"""Leakage-aware splits: captures, never rows, are assigned to roles and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Role ranges over captures in order of time, folds ``(train from, to, validate from, to)``, held-out families.
FINAL_TEST = (28, 45)
FOLDS = ((0, 9, 9, 14), (0, 14, 14, 22), (0, 22, 22, 28))
HOLDOUT_FAMILIES = ("tcp_syn_flood", "tcp_rst", "udp_flood")


def capture_inventory(flows: DataFrame) -> DataFrame:
    """``flows``: ``capture, family, start_ts, n_packets``. One row a capture."""
    return flows.groupBy("capture").agg(F.min("family").alias("family"), F.min("start_ts").alias("first_ts"), F.count("*").alias("n_flows"), F.sum("n_packets").alias("n_packets"))


def chronological_manifest(captures: DataFrame, final_test: tuple[int, int] = FINAL_TEST, folds: tuple = FOLDS, holdout: tuple[str, ...] = HOLDOUT_FAMILIES) -> DataFrame:
    """Roles of captures by their rank in time. There is one row a capture, so one ordered list is small."""
    i = F.row_number().over(Window.orderBy("first_ts", "capture")) - 1
    ranked = captures.withColumn("rank", i)
    role, fold = F.lit("train"), F.lit(None).cast("int")
    # Later folds overwrite the training fold; a validation fold stays, as later training windows include it.
    for k, (lo, hi, vlo, vhi) in enumerate(folds, 1):
        validates = (F.col("rank") >= vlo) & (F.col("rank") < vhi)
        role = F.when(validates, "val").otherwise(role)
        fold = F.when(validates | ((F.col("rank") >= lo) & (F.col("rank") < hi)), k).otherwise(fold)
    final = (F.col("rank") >= final_test[0]) & (F.col("rank") < final_test[1])
    held = F.when(F.col("family").isin(*holdout), "holdout").otherwise("train")
    return ranked.select(
        "capture", "family", "first_ts", F.date_format(F.timestamp_seconds("first_ts"), "yyyy-MM-dd").alias("date"), "n_flows", "n_packets",
        F.when(final, "final_test").otherwise(role).alias("track_a_role"), F.when(final, -1).otherwise(fold).alias("track_a_fold"), F.when(final, "final_test").otherwise(held).alias("track_b_role"),
    )


def expanding_folds(ranked: DataFrame, folds: tuple = FOLDS) -> DataFrame:
    """Each fold's captures with their part in it, ``train`` or ``val``. ``ranked`` has ``capture, rank``."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), *[F.lit(x).alias(n) for n, x in zip(("lo", "hi", "vlo", "vhi"), f, strict=True)]) for k, f in enumerate(folds, 1)]))
    r = F.col("rank")
    part = F.when((r >= F.col("f.vlo")) & (r < F.col("f.vhi")), "val").when((r >= F.col("f.lo")) & (r < F.col("f.hi")), "train")
    return ranked.withColumn("f", rows).withColumn("part", part).where("part is not null").select("capture", "rank", F.col("f.fold").alias("fold"), "part")


def role_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("track_a_role", "track_a_fold").agg(F.count("*").alias("captures"), F.sum("n_flows").alias("flows"))


def verify_manifest(manifest: DataFrame) -> DataFrame:
    """Violations, one row each kind: captures listed twice, and both-role captures. Counts of 0 are good."""
    twice = manifest.groupBy("capture").count().where("count > 1").agg(F.count("*").alias("violations")).withColumn("rule", F.lit("capture_listed_twice"))
    both = manifest.groupBy("capture").agg(F.count_distinct("track_a_role").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).withColumn("rule", F.lit("capture_in_two_roles"))
    test = manifest.where("(track_a_role = 'final_test') <> (track_b_role = 'final_test')").agg(F.count("*").alias("violations")).withColumn("rule", F.lit("final_test_differs_by_track"))
    return twice.unionByName(both).unionByName(test).select("rule", "violations")


def group_folds(captures: DataFrame, n_splits: int = 5, seed: int = 42, tries: int = 200) -> dict[str, int]:
    """Folds of whole captures with both classes in each, balanced by rows.

    ``captures``: ``capture, n_pos, n_neg``, one row a capture and so few that they are assigned on the driver.
    """
    import random

    rows = [(r["capture"], r["n_pos"], r["n_neg"]) for r in captures.orderBy("capture").collect()]
    for attempt in range(tries):
        rng = random.Random(seed + attempt)
        order = sorted(rows, key=lambda r: (-(r[1] + r[2]), rng.random()))
        sums, out = [[0, 0] for _ in range(n_splits)], {}
        for name, pos, neg in order:
            k = min(range(n_splits), key=lambda j: (sums[j][0] * (pos > 0) + sums[j][1] * (neg > 0), rng.random()))
            sums[k][0] += pos
            sums[k][1] += neg
            out[name] = k
        if all(p and n for p, n in sums):
            return out
    raise ValueError("no assignment gives every fold both classes")
