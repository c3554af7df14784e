"""The three definitions of a percentile that reports use, each for every group of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Percentiles of a profile.
PERCENTILES = (0, 5, 25, 50, 75, 95, 100)


def linear(df: DataFrame, by: list[str], value: str, percents=PERCENTILES, weight: str | None = None) -> DataFrame:
    """by..., percent, value: linear between neighbours at (n - 1) * p / 100; weight repeats a row."""
    shares = F.array(*[F.lit(p / 100) for p in percents])
    found = F.percentile(value, shares, F.col(weight)) if weight else F.percentile(value, shares)
    points = df.groupBy(*by).agg(found.alias("points"))
    return points.select(*by, F.posexplode("points").alias("i", "value")).select(*by, F.element_at(F.array(*map(F.lit, percents)), F.col("i") + 1).alias("percent"), "value")


def _cumulated(df: DataFrame, by: list[str], value: str, weight: str | None) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    every = Window.partitionBy(*by)
    return counts.withColumn("upto", F.sum("n").over(every.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(every))


def lower(df: DataFrame, by: list[str], value: str, percents=(0, 10, 50, 90, 100)) -> DataFrame:
    """by..., percent, value: the value at index min(n - 1, floor(p * n)) of the sorted values; over distinct values and counts."""
    at = F.least(F.col("total") - 1, F.floor(F.col("percent") * F.col("total") / 100))
    wanted = _cumulated(df, by, value, None).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    return wanted.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select(*by, "percent", "value")


def weighted(df: DataFrame, by: list[str], value: str, weight: str, percents=PERCENTILES) -> DataFrame:
    """by..., percent, value: the smallest value whose cumulated weight reaches p of the total."""
    wanted = _cumulated(df, by, value, weight).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    return wanted.where(F.col("upto") >= F.col("percent") * F.col("total") / 100).groupBy(*by, "percent").agg(F.min("value").alias("value"))
