"""Order-based operators: neighbours, dilation, thresholds, modes, repeats, inverted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def threewise(df: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """``(by, order, before, at, after)`` of each row that has both neighbours, whatever their values; nulls are values like others."""
    w = Window.partitionBy(by).orderBy(order)
    there = (F.lag(F.lit(True)).over(w) & F.lead(F.lit(True)).over(w)).alias("there")
    return df.select(by, order, F.lag(value).over(w).alias("before"), F.col(value).alias("at"), F.lead(value).over(w).alias("after"), there).where("there").drop("there")


def threshold_fill(value: Column, threshold: float, window: WindowSpec) -> Column:
    """The value if it reaches the threshold, else the last that did in the window's order, else 0."""
    good = F.when(value >= threshold, value)
    return F.coalesce(F.last(good, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def dilate(mask: Column, n: int, window: WindowSpec) -> Column:
    """Whether the mask holds in the row or one of the n - 1 rows before."""
    return F.max(mask).over(window.rowsBetween(-(n - 1), 0))


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the one that comes first; null values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.min_by(F.col(value), F.struct(-F.col("n"), F.col("first"), F.col(value)))
    return counts.groupBy(*by).agg(best.alias(value), F.max("n").alias("n"))


def repeating(df: DataFrame, by: str, value: str, order: str, count: int = 2) -> DataFrame:
    """The first ``count`` re-occurrences of values in each group, none for a group that has fewer."""
    again = F.row_number().over(Window.partitionBy(by, value).orderBy(order)) > 1
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = df.withColumn("again", again).where("again").withColumn("place", place).where(F.col("place") <= count)
    return rows.withColumn("there", F.count("*").over(Window.partitionBy(by))).where(F.col("there") >= count).select(by, "place", value)


def invert_lists(df: DataFrame, key: str, values: str) -> DataFrame:
    """``(value, key)``: of each value the keys whose list has it, a row for each, so that a value may have any number of keys."""
    return df.select(F.explode(values).alias("value"), key).distinct()


def number_rows(df: DataFrame, by: str, *order: str | Column) -> DataFrame:
    """``seq``: the place in each group, from 0."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in an order that depends on the seed."""
    return df.orderBy(F.rand(seed))


def first_rows(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows by an explicit order (a top-k: no full sort)."""
    return df.orderBy(*order).limit(n)
