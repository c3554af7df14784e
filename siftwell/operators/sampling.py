"""Seeded and even samples, splits, row numbers. Orders come from digests of keys, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seeded_order, seeded_uniform

#: Slots that positions are dealt into.
SLOTS = 4096


def even_sample(df: DataFrame, by: list[str], order: str, sample: int) -> DataFrame:
    """Rows at index floor(i * n / sample), i < sample, of each group in order; the whole group if it has no more."""
    here = Window.partitionBy(*by)
    rows = df.withColumn("__i", F.row_number().over(here.orderBy(order)) - 1).withColumn("__n", F.count("*").over(here))
    first = F.ceil(F.col("__i") * sample / F.col("__n"))  # the least i whose index can be this row
    hit = (F.col("__n") <= sample) | ((first < sample) & (F.floor(first * F.col("__n") / sample) == F.col("__i")))
    return rows.where(hit).drop("__i", "__n")


def prefix(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group; 0 is no limit."""
    if not n:
        return df
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__i") <= n).drop("__i")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement; a smaller n gives a part of a larger one's rows."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def sample_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(seeded_order(seed, F.col(key)), key))
    return df.withColumn("sample_index", rank).where(F.col("sample_index") <= n)


def shuffled_wrapped(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of a seeded shuffle that starts anew when it is used up: replica counts the rounds."""
    size = df.count()
    if not size:
        return df.withColumn("replica", F.lit(0))
    rounds = -(-n // size)
    copies = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return copies.orderBy("replica", seeded_order(seed, F.col(key)), key).limit(n)


def assign_split(df: DataFrame, key: str, n: int, seed: int, name: str = "val") -> DataFrame:
    """split: name for n seeded rows, train for the others. No file moves."""
    chosen = sample_n(df.select(key).distinct(), key, n, seed).withColumn("split", F.lit(name))
    return df.join(chosen, key, "left").na.fill("train", ["split"])


def numbered(df: DataFrame, shard: str, row: str) -> DataFrame:
    """global_row: 0-based over all rows by (shard, row). Only the shards' counts pass through one task."""
    counts = df.groupBy(shard).agg(F.count("*").alias("__n"))
    offsets = counts.select(shard, (F.sum("__n").over(Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(shard).orderBy(row)) - 1
    return df.withColumn("__at", within).join(offsets, shard).withColumn("global_row", F.col("__before") + F.col("__at")).drop("__at", "__before")


def sample_joint(df: DataFrame, key: str, dims: DataFrame, seed: int) -> DataFrame:
    """width and height drawn with replacement from the rows of dims, for each row of df by its key.

    dims is a histogram (width, height, n): the draw is a position among all its images. Ranges of positions are cut up into
    slots, on which positions are joined.
    """
    order = Window.orderBy("width", "height")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranges = dims.select("width", "height", (upto - F.col("n")).alias("first"), upto.alias("after"))
    total = dims.agg(F.sum("n")).first()[0] or 0
    slot = max(1, total // SLOTS)
    ranges = ranges.withColumn("__slot", F.explode(F.sequence(F.floor(F.col("first") / slot), F.floor((F.col("after") - 1) / slot))))
    rows = df.withColumn("__p", F.floor(seeded_uniform(seed, F.col(key)) * total)).withColumn("__slot", F.floor(F.col("__p") / slot))
    inside = (F.col("__p") >= F.col("first")) & (F.col("__p") < F.col("after"))
    return rows.join(ranges, "__slot").where(inside).drop("__p", "__slot", "first", "after")


def even_rows(df: DataFrame, path: str, sample: int) -> DataFrame:
    """even_sample of all rows by their path, without gathering them: paths are numbered by folder and first letters of the name."""
    rows = numbered(df.withColumn("__start", F.regexp_extract(path, r"\A(.*/)?.{0,3}", 0)), "__start", path)
    n = df.count()
    first = F.ceil(F.col("global_row") * sample / n) if n else F.lit(0)
    hit = F.lit(n <= sample) | ((first < sample) & (F.floor(first * n / sample) == F.col("global_row")))
    return rows.where(hit).drop("__start", "global_row")
