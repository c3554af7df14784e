"""Statistics and standardisation of feature arrays, and small helpers of image features."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Families up to which their statistics are broadcast: some thousand numbers each.
MOST_FAMILIES = 1000


def feature_stats(features: DataFrame) -> DataFrame:
    """family, dim, mean, std (population) of rows (family, values, valid); invalid rows don't count. Sums merge across tasks."""
    each = features.where("valid").select("family", F.posexplode("values").alias("dim", "x")).withColumn("x", F.coalesce(F.col("x").cast("double"), F.lit(0.0)))
    return each.groupBy("family", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardised(features: DataFrame, stats: DataFrame, floor: float = 1e-3, clip: float = 8.0) -> DataFrame:
    """values as clip((x - mean) / max(std, floor)); not a number and infinities count as 0."""
    packed = stats.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    finite = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double"))
    z = lambda x, s: F.greatest(F.lit(-clip), F.least(F.lit(clip), (finite(x) - s["mean"]) / F.greatest(s["std"], F.lit(floor))))
    few = packed.limit(MOST_FAMILIES + 1).count() <= MOST_FAMILIES
    return features.join(F.broadcast(packed) if few else packed, "family").withColumn("values", F.zip_with("values", "s", z)).drop("s")


def write_stats(stats: DataFrame, path: str, config: dict, version: int) -> None:
    """Statistics with what they were computed from, as one table."""
    stats.select("*", F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.lit(version).alias("version")).write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("family", "dim", "mean", "std")


def guarded_stats(spark: SparkSession, path: str, config: dict, version: int, compute: Callable[[], DataFrame]) -> DataFrame:
    """Statistics from path if they are there: of another config they are an error, of another version they are computed anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.parquet(path).select("config", "version").first()
        if known and json.loads(known["config"]) != config:
            raise ValueError(f"{path} holds statistics of another config: {known['config']}")
        if known and known["version"] == version:
            return read_stats(spark, path)
    write_stats(compute(), path, config, version)
    return read_stats(spark, path)


def as_rgb(img: np.ndarray) -> np.ndarray:
    """height x width x 3 floats in 0..255; grey is repeated, alpha dropped, unit range scaled up."""
    a = np.asarray(img, np.float32)
    a = a[..., None] if a.ndim == 2 else a
    a = np.repeat(a, 3, -1) if a.shape[-1] == 1 else a[..., :3]
    return a * 255 if a.size and a.max() <= 1.5 else a


def luma(rgb: np.ndarray) -> np.ndarray:
    """The grey of ... x 3 arrays."""
    return np.asarray(rgb, np.float64)[..., :3] @ np.array([0.299, 0.587, 0.114])


def moments(x: np.ndarray) -> np.ndarray:
    """Mean, standard deviation, skewness and excess kurtosis over the last axis; the latter are 0 where nothing varies."""
    x = np.asarray(x, np.float64)
    mean, std = x.mean(-1), x.std(-1)
    varies = std > 1e-12
    z = (x - mean[..., None]) / np.where(varies, std, 1)[..., None] * varies[..., None]
    return np.stack([mean, std, (z**3).mean(-1), np.where(varies, (z**4).mean(-1) - 3, 0)], -1)


#: Values that a robust scale looks at, about.
SCALED = 16_384


def robust_scale(x: np.ndarray, floor: float = 1e-2) -> np.ndarray:
    """The median distance from the median over the last axis, as a Gaussian's standard deviation; floor at least."""
    some = np.asarray(x, np.float64)[..., :: max(1, np.shape(x)[-1] // SCALED)]
    distance = np.abs(some - np.median(some, axis=-1, keepdims=True))
    return np.maximum(1.4826 * np.median(distance, axis=-1), floor)


def corr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's correlation over the last axis; 0 where one side doesn't vary."""
    x, y = (v - v.mean(-1, keepdims=True) for v in (np.asarray(x, np.float64), np.asarray(y, np.float64)))
    size = np.sqrt((x * x).sum(-1) * (y * y).sum(-1))
    return np.where(size > 1e-12, (x * y).sum(-1) / np.where(size > 1e-12, size, 1), 0.0)


def block_dct(grey: np.ndarray, size: int = 8) -> np.ndarray:
    """Coefficients (blocks, size, size) of the orthonormal cosine transform of whole blocks."""
    k = np.arange(size)
    basis = np.sqrt(2 / size) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * size))
    basis[0] /= np.sqrt(2)
    h, w = (n // size * size for n in grey.shape)
    blocks = grey[:h, :w].reshape(h // size, size, w // size, size).swapaxes(1, 2).reshape(-1, size, size)
    return basis @ blocks @ basis.T
