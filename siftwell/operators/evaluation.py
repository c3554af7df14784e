"""Evaluation of binary predictions (path, label, prob): label 1 is the positive class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, round_label, wrong_confidence

#: Ranges of confidence in which failures are ranked.
RANGES = 4096
METRICS = ("accuracy", "precision", "recall", "f1", "real_accuracy", "aigen_accuracy")


def classify(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return predictions.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def confusion(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    cell = lambda p, y: F.count_if((F.col("pred") == p) & (F.col("label") == y))
    return predictions.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))


def metrics(cells: DataFrame) -> DataFrame:
    """Adds the six rates to tp, fp, fn, tn; a rate without cases is 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = cells.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": ratio(2 * p * r, p + r), "real_accuracy": ratio(tn, tn + fp), "aigen_accuracy": r})


def class_counts(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(F.count_if(F.col("label") == 0).alias("real"), F.count_if(F.col("label") == 1).alias("ai_gen"), F.count("*").alias("total"))


def mean_prob_by_class(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Null for a class without rows."""
    of = lambda y: F.avg(F.when(F.col("label") == y, F.col("prob")))
    return predictions.groupBy(*by).agg(of(0).alias("mean_prob_real"), of(1).alias("mean_prob_aigen"))


def round_results(predictions: DataFrame) -> DataFrame:
    """One row for each augment and variant, all rounds in one pass: cells, rates, class sizes, mean probabilities."""
    by = ("augment", "variant")
    out = metrics(confusion(predictions, by)).join(class_counts(predictions, by), list(by)).join(mean_prob_by_class(predictions, by), list(by))
    return out.withColumn("round", round_label(F.col("augment"), F.col("variant")))


def with_throughput(rounds: DataFrame, seconds: DataFrame) -> DataFrame:
    """rounds with seconds and images_per_second, from the time that each (augment, variant) took; null without a time above 0."""
    out = rounds.join(seconds.select("augment", "variant", "seconds"), ["augment", "variant"], "left")
    return out.withColumn("images_per_second", F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")))


def running_accuracy(predictions: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, n, accuracy: over all rows up to the end of each batch, from the batches' sums."""
    sums = predictions.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("right"))
    upto = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(batch, F.sum("n").over(upto).alias("n"), (F.sum("right").over(upto) / F.sum("n").over(upto)).alias("accuracy"))


def mean_metrics(rounds: DataFrame, by: tuple[str, ...] = ("augment",)) -> DataFrame:
    """The unweighted mean of the rounds' rates."""
    return rounds.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("rounds"))


def failures(predictions: DataFrame) -> DataFrame:
    """Wrong predictions; order_in_label counts from the most confident one of each label."""
    wrong = predictions.where("pred <> label").withColumn("confidence", wrong_confidence(F.col("prob"), F.col("pred")))
    # a label is ranked in ranges of confidence, so that no task sorts all of it; what stands ahead of a range is counted
    wrong = wrong.withColumn("range", F.floor(F.col("confidence") * RANGES))
    sizes = wrong.groupBy("label", "range").agg(F.count("*").alias("size"))
    ahead = F.sum("size").over(Window.partitionBy("label").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))
    wrong = wrong.join(sizes.select("label", "range", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["label", "range"])
    rank = F.row_number().over(Window.partitionBy("label", "range").orderBy(F.desc("confidence"), "path")) + F.col("ahead")
    return _shown(wrong, rank)


def _shown(wrong: DataFrame, rank: Column) -> DataFrame:
    name = lambda c: F.when(F.col(c) == 1, "ai_gen").otherwise("real")
    return wrong.select("path", "label", name("label").alias("label_name"), "pred", name("pred").alias("pred_name"), F.col("prob").alias("prob_aigen"), "confidence", rank.cast("int").alias("order_in_label"))


def top_failures(predictions: DataFrame, k: int) -> DataFrame:
    """The k most confident failures of each label: tasks keep their own k before any row moves."""
    wrong = predictions.where("pred <> label").withColumn("confidence", wrong_confidence(F.col("prob"), F.col("pred")))
    wrong = wrong.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("confidence"), "path"))).where(F.col("rank") <= k)
    return _shown(wrong, F.col("rank"))


def limit_per_class(samples: DataFrame, n: int) -> DataFrame:
    """The first n of each label in the order of their paths; rows of one path by their other columns."""
    order = ["path", *[c for c in samples.columns if c not in ("path", "label")]]
    return samples.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def rounds_of(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Every sample under every round of the grid, which is a short list of parameters and so is broadcast."""
    return samples.crossJoin(F.broadcast(grid))


def auroc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half. An addition of this library."""
    steps = predictions.groupBy("prob").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    # distinct scores are summed in ranges first, so that no window holds them all
    coarse = steps.withColumn("range", F.floor(F.col("prob") * 1024))
    sums = coarse.groupBy("range").agg(F.sum("n").alias("range_n"))
    below = sums.withColumn("below", F.coalesce(F.sum("range_n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = coarse.join(below, "range").withColumn("lower", F.col("below") + inside)
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"))
