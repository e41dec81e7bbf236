"""Data-quality audits: duplicates, constant columns, ranges, accounting, comparison of two derivations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.ranks import with_rank


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, distinct rows and surplus rows on ``cols``; grouping keeps copies from meeting."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def keep_first(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*cols).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cross_group_duplicates(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Pairs of groups and the number of distinct rows they share; pairs of groups, not of rows, meet."""
    seen = df.select(group, F.xxhash64(*cols).alias("h")).distinct()
    sets = seen.groupBy("h").agg(F.array_sort(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    a = sets.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("g") - 2)))
    b = a.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("g") - 1)))
    return b.groupBy(F.get("g", F.col("i")).alias("group_a"), F.get("g", F.col("j")).alias("group_b")).agg(F.count("*").alias("shared"))


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: nulls, not finite, distinct values, minimum, maximum, and whether it is constant."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    # Distinct values by grouping first: the distinct count then needs no expansion.
    at = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    out = at.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("not_finite"),
        F.count("v").alias("distinct_values"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
    )
    return out.withColumn("constant", F.coalesce(F.col("min_value") == F.col("max_value"), F.lit(True)))


def systematic_sample(df: DataFrame, order: list[str], target: int = 20_000) -> DataFrame:
    """Every k-th row in order, k = max(1, n // target); a number leads the order."""
    k = max(1, df.count() // target)
    return with_rank(df, order, "_r").where((F.col("_r") - 1) % k == 0).drop("_r")


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a seeded hash of ``key``: the same ones whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def capture_duplicates(flows: DataFrame) -> DataFrame:
    """Per capture: flows, distinct flow ids and surplus ones."""
    each = flows.groupBy("capture_file", "flow_id").agg(F.count("*").alias("n"))
    return each.groupBy("capture_file").agg(F.sum("n").alias("flows"), F.count("*").alias("flow_ids"), F.sum(F.col("n") - 1).alias("duplicates"))


def accounting(packets: DataFrame, key: str, status: str, kinds: list[str]) -> DataFrame:
    """Records by parse status, and whether they add up."""
    out = packets.groupBy(key).agg(F.count("*").alias("records"), *[F.count_if(F.col(status) == k).alias(k) for k in kinds])
    return out.withColumn("balanced", F.col("records") == sum((F.col(k) for k in kinds), F.lit(0)))


def compare_derivations(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per column: rows compared and rows beyond the tolerance max(1, 0.1 % of b)."""
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols]), keys)

    def off(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.abs(x - y) > F.greatest(F.lit(1.0), 1e-3 * F.abs(y))

    wide = both.agg(F.count("*").alias("n"), *[F.count_if(off(c)).alias(c) for c in cols])
    return wide.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches")) for c in cols])).alias("x")).select("x.column", F.col("n").alias("compared"), "x.mismatches")


def validate_schema(df: DataFrame, expected: dict[str, str], forbidden: tuple[str, ...] = ()) -> list[str]:
    """What differs from the declared columns and types; forbidden columns are named too."""
    have = dict(df.dtypes)
    out = [f"missing column {c}" for c in expected if c not in have]
    out += [f"unexpected column {c}" for c in have if c not in expected]
    out += [f"column {c} is {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
    return out + [f"identifier {c} is a feature" for c in forbidden if c in expected]


def finite(cols: list[str]) -> Column:
    return reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), cols, F.lit(True))
