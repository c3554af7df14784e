"""Calibration by buckets of a score: counts for each class, Bayes posteriors, lookup."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket_of
from .evaluation import class_counts, confusion, metrics


def histogram(predictions: DataFrame, buckets: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., idx, count_real, count_aigen of predictions (label, prob): every bucket, also empty ones. Sums of histograms are histograms."""
    spark = predictions.sparkSession
    counts = predictions.groupBy(*by, bucket_of(F.col("prob"), buckets).alias("idx")).agg(F.count_if(F.col("label") == 0).alias("count_real"), F.count_if(F.col("label") == 1).alias("count_aigen"))
    every = F.broadcast(spark.range(buckets).select(F.col("id").cast("int").alias("idx")))
    if by:
        every = predictions.select(*by).distinct().crossJoin(every)
    return every.join(counts, [*by, "idx"], "left").na.fill(0, ["count_real", "count_aigen"])


def merged(histograms: DataFrame) -> DataFrame:
    return histograms.groupBy("idx").agg(F.sum("count_real").alias("count_real"), F.sum("count_aigen").alias("count_aigen"))


def table(counts: DataFrame, buckets: int, prior_aigen: float | None = None, smoothing: float = 1.0) -> DataFrame:
    """The lookup table from a histogram (idx, count_real, count_aigen), one row for each bucket.

    Likelihoods are smoothed by class; a prior of None is the share of positives (0.5 without rows); a bucket without
    evidence has no posterior, label and confidence; a posterior of exactly 0.5 is ai_gen.
    """
    whole = Window.partitionBy()
    n_real, n_aigen = F.sum("count_real").over(whole), F.sum("count_aigen").over(whole)
    prior = F.lit(prior_aigen) if prior_aigen is not None else F.coalesce(F.try_divide(n_aigen, n_real + n_aigen), F.lit(0.5))
    likelihood = lambda c, n: F.coalesce(F.try_divide(F.col(c) + smoothing, n + buckets * smoothing), F.lit(0.0))
    rows = counts.select("idx", "count_real", "count_aigen", likelihood("count_real", n_real).alias("p_c_given_real"), likelihood("count_aigen", n_aigen).alias("p_c_given_aigen"), prior.alias("prior"))
    joint = F.col("p_c_given_aigen") * F.col("prior")
    rows = rows.withColumn("p_aigen_given_c", F.try_divide(joint, joint + F.col("p_c_given_real") * (1 - F.col("prior"))))
    post = F.col("p_aigen_given_c")
    return rows.select(
        (F.col("idx") + 1).alias("bucket"), (F.col("idx") / buckets).alias("lower"), ((F.col("idx") + 1) / buckets).alias("upper"), "count_real", "count_aigen", "p_c_given_real", "p_c_given_aigen",
        (1 - post).alias("p_real_given_c"), "p_aigen_given_c", F.try_divide(F.col("count_aigen"), F.col("count_real") + F.col("count_aigen")).alias("empirical_p_aigen"),
        F.when(post >= 0.5, "ai_gen").when(post < 0.5, "real").alias("predicted_label"), F.greatest(post, 1 - post).alias("confidence"),
    )


def lookup(scores: DataFrame, calibration: DataFrame, buckets: int) -> DataFrame:
    """Adds predicted_label and confidence by the bucket of prob; the table has one row for each bucket and is broadcast."""
    keyed = scores.withColumn("bucket", bucket_of(F.col("prob"), buckets) + 1)
    return keyed.join(F.broadcast(calibration.select("bucket", "predicted_label", "confidence")), "bucket", "left")


def read_deployed(spark: SparkSession, path: str) -> DataFrame:
    """A deployed table: {"num_buckets": K, "table": [{"predicted_label", "confidence"}, ...]}; bucket is 1-based."""
    schema = "num_buckets int, table array<struct<predicted_label:string,confidence:double>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("table").alias("i", "row")).select((F.col("i") + 1).alias("bucket"), "row.*")


def deployed_json(calibration: DataFrame) -> str:
    rows = [r.asDict() for r in calibration.orderBy("bucket").select("predicted_label", "confidence").collect()]
    return json.dumps({"num_buckets": len(rows), "table": rows}, indent=2)


def seeded_rounds(images: DataFrame, rounds: int, seed: int) -> DataFrame:
    """images under each of so many rounds: round (1 and on) and its seed (seed + round - 1). Rounds are few and broadcast."""
    numbers = images.sparkSession.range(1, rounds + 1).select(F.col("id").cast("int").alias("round"), (F.col("id") + (seed - 1)).alias("seed"))
    return images.crossJoin(F.broadcast(numbers))


def round_tables(predictions: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The cells, rates and class sizes of every round of predictions (round, label, prob, pred), and its histogram, in one pass each."""
    cells = metrics(confusion(predictions, ("round",))).join(class_counts(predictions, ("round",)), "round")
    return cells, histogram(predictions, buckets, ("round",))


def demo(score: float, calibration: DataFrame, buckets: int) -> dict:
    """label and confidence of one score by a table."""
    found = lookup(calibration.sparkSession.createDataFrame([(float(score),)], "prob double"), calibration, buckets).first()
    return {"prob": float(score), "label": found["predicted_label"], "confidence": found["confidence"]}
