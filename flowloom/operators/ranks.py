"""Global ranks and running sums without a single task.

Rows are cut into slots by quantiles of a number that leads the order; every slot is numbered by its own
window and adds what the slots before it hold. Only one row a slot reaches the driver. A row's slot
follows from its value, so the two passes agree whatever the partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 64


def _slotted(df: DataFrame, lead: str, slots: int) -> DataFrame:
    value = F.col(lead).cast("double")
    cuts = sorted({x for x in df.select(value.alias("v")).approxQuantile("v", [k / slots for k in range(1, slots)], 0.001) if math.isfinite(x)})
    return df.withColumn("_slot", sum(((value >= F.lit(x)).cast("int") for x in cuts), F.lit(0)))


def _before(slotted: DataFrame, sums: dict[str, Column], falling: bool) -> dict[str, Column]:
    """Of each sum, what the slots before a row's slot hold."""
    held = {r["_slot"]: r for r in slotted.groupBy("_slot").agg(*[F.sum(x).alias(name) for name, x in sums.items()]).collect()}
    out = {}
    for name in sums:
        total, pairs = 0, []
        for slot in sorted(held, reverse=falling):
            pairs += [F.lit(slot), F.lit(total)]
            total += held[slot][name] or 0
        out[name] = F.create_map(*pairs)[F.col("_slot")] if pairs else F.lit(0)
    return out


def with_rank(df: DataFrame, order: list[str], name: str = "rank", slots: int = SLOTS) -> DataFrame:
    """``name``: the row's place, from 1, in ascending ``order``, which a number leads; nulls come first."""
    slotted = _slotted(df, order[0], slots).withColumn("_slot", F.coalesce("_slot", F.lit(-1)))
    start = _before(slotted, {"n": F.lit(1)}, False)["n"]
    own = F.row_number().over(Window.partitionBy("_slot").orderBy(*order))
    return slotted.withColumn(name, (own + start).cast("long")).drop("_slot")


def with_running(df: DataFrame, lead: str, sums: dict[str, str], slots: int = SLOTS) -> DataFrame:
    """Running sums by descending ``lead``, whose values differ: ``sums`` maps the new column to the one summed."""
    slotted = _slotted(df, lead, slots)
    before = _before(slotted, {name: F.col(c) for name, c in sums.items()}, True)
    w = Window.partitionBy("_slot").orderBy(F.desc(lead)).rowsBetween(Window.unboundedPreceding, 0)
    return slotted.withColumns({name: F.sum(c).over(w) + before[name] for name, c in sums.items()}).drop("_slot")
