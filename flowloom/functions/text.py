"""Scalar functions on names and report lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def slugify(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "_"), F.lit("_"))


def mapped_or_slug(name: Column, families: dict[str, str]) -> Column:
    """The family of a directory name, or its slug."""
    if not families:
        return slugify(name)
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    return F.coalesce(table[name], slugify(name))


def contains_all(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, p: a & F.contains(F.lower(text), F.lit(p.lower())), parts, F.lit(True))


def plain_number(text: Column) -> Column:
    """A number written with thousands separators."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def markdown_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the rows of markdown tables in a file, without separators; ``cells`` is an array."""
    line = F.trim("value")
    cells = F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.startswith(line, F.lit("|"))).select(cells.alias("cells"))
    return rows.where(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))


def log_fields(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row a line that matches every pattern; each has one group, a number with or without commas."""
    lines = spark.read.text(path)
    found = {name: plain_number(F.regexp_extract("value", p, 1)) for name, p in patterns.items()}
    out = lines.select("value", *[c.alias(n) for n, c in found.items()])
    return out.where(reduce(lambda a, n: a & F.col(n).isNotNull(), patterns, F.lit(True)))
