"""Profiles of sizes and formats: percentiles, shares, counts, mismatches, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.percentiles import PERCENTILES
from ..functions.scalars import EXTENSION_FORMATS, aspect_bucket, long_bucket, measures, orientation, patch_grid, scale_direction


def dims_profile(headers: DataFrame, by: str = "split", percents=PERCENTILES) -> DataFrame:
    """by, measure, mean and p0..p100 (linear) of sizes (width, height)."""
    m = measures(F.col("width"), F.col("height"))
    long = headers.select(by, *[c.alias(k) for k, c in m.items()]).unpivot([by], list(m), "measure", "value")
    points = long.groupBy(by, "measure").agg(F.avg("value").alias("mean"), F.percentile("value", F.array(*[F.lit(p / 100) for p in percents])).alias("points"))
    return points.select(by, "measure", "mean", *[F.col("points")[i].alias(f"p{p}") for i, p in enumerate(percents)])


def orientation_shares(headers: DataFrame, by: str = "split") -> DataFrame:
    kind = orientation(F.col("width"), F.col("height"))
    share = lambda x: F.avg((kind == x).cast("double")).alias(x)
    return headers.groupBy(by).agg(F.count("*").alias("images"), F.count_distinct("width", "height").alias("resolutions"), share("landscape"), share("portrait"), share("square"))


def compare_splits(headers: DataFrame, by: str = "split") -> DataFrame:
    """One row for each split: medians and shares side by side."""
    m = measures(F.col("width"), F.col("height"))
    medians = headers.groupBy(by).agg(*[F.median(c).alias(f"median_{k}") for k, c in m.items()])
    return orientation_shares(headers, by).join(medians, by)


def most_common(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent keys with their count and share; ties by key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    return counts.crossJoin(total).select(*keys, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), *keys).limit(k)


def top_resolutions(headers: DataFrame, by: str = "split", k: int = 10) -> DataFrame:
    counts = headers.groupBy(by, "width", "height").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "width", "height"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def value_shares(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n and share of n in by."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def format_sizes(headers: DataFrame, percents=PERCENTILES) -> DataFrame:
    """format, n, total_mb, mean_kb and percentiles of the size in KB."""
    points = headers.groupBy("format").agg(F.count("*").alias("n"), (F.sum("bytes") / 1e6).alias("total_mb"), (F.avg("bytes") / 1e3).alias("mean_kb"), F.percentile(F.col("bytes") / 1e3, F.array(*[F.lit(p / 100) for p in percents])).alias("points"))
    return points.select("format", "n", "total_mb", "mean_kb", *[F.col("points")[i].alias(f"p{p}_kb") for i, p in enumerate(percents)])


def mismatches(headers: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """ext, format, n and the first path of files whose extension promises another format (or none that is known)."""
    promised = F.create_map(*[F.lit(x) for kv in (expected or EXTENSION_FORMATS).items() for x in kv])
    wrong = headers.where(~F.try_element_at(promised, F.col("ext")).eqNullSafe(F.col("format")))
    return wrong.groupBy("ext", "format").agg(F.count("*").alias("n"), F.min("path").alias("example"))


def good_and_bad(headers: DataFrame) -> DataFrame:
    return headers.groupBy("split").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"))


def weighted_profile(resolutions: DataFrame, percents=PERCENTILES) -> DataFrame:
    """measure, mean and percentiles of a histogram (width, height, n), as if every row stood n times."""
    m = measures(F.col("width"), F.col("height"))
    long = resolutions.select("n", *[c.alias(k) for k, c in m.items()]).unpivot(["n"], list(m), "measure", "value")
    points = long.groupBy("measure").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.percentile("value", F.array(*[F.lit(p / 100) for p in percents]), F.col("n")).alias("points"))
    return points.select("measure", "mean", *[F.col("points")[i].alias(f"p{p}") for i, p in enumerate(percents)])


def size_buckets(resolutions: DataFrame) -> DataFrame:
    """long, aspect and images of a histogram (width, height, n)."""
    w, h = F.col("width"), F.col("height")
    return resolutions.groupBy(long_bucket(w, h).alias("long"), aspect_bucket(w, h).alias("aspect")).agg(F.sum("n").alias("images"))


def ranked_buckets(headers: DataFrame) -> DataFrame:
    """rank, width, height, count, cum_share and before (images of earlier ranks): resolutions, most frequent first.

    The windows run over distinct resolutions, of which there are few, not over images.
    """
    counts = headers.groupBy("width", "height").agg(F.count("*").alias("count"))
    order = Window.orderBy(F.desc("count"), "width", "height")
    upto = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(F.row_number().over(order).alias("rank"), "width", "height", "count", (upto / F.sum("count").over(Window.partitionBy())).alias("cum_share"), (upto - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("total"))


def head_images(headers: DataFrame, coverage: float) -> DataFrame:
    """Buckets that hold the first coverage of the images, the one that crosses included."""
    return ranked_buckets(headers).withColumn("kept", F.col("before") < coverage * F.col("total")).drop("before", "total")


def head_buckets(headers: DataFrame, coverage: float) -> DataFrame:
    """The first coverage of the buckets, one at least."""
    n = F.count("*").over(Window.partitionBy())
    return ranked_buckets(headers).withColumn("kept", F.col("rank") <= F.greatest(F.lit(1), F.ceil(coverage * n))).drop("before", "total")


def scale_profile(resolutions: DataFrame, patch: int = 16, most: int = 256) -> DataFrame:
    """width, height, n, rows, cols, tokens, scale and direction of a histogram (width, height, n): what a patch grid makes of each size."""
    w, h = F.col("width"), F.col("height")
    grid = patch_grid(w, h, patch, most)
    rows = resolutions.select("width", "height", "n", grid.alias("grid")).select("width", "height", "n", "grid.rows", "grid.cols")
    scale = F.sqrt(F.col("rows") * F.col("cols") * float(patch * patch) / (w * h))
    return rows.withColumns({"tokens": F.col("rows") * F.col("cols"), "scale": scale, "direction": scale_direction(scale)})


def scale_shares(profile: DataFrame) -> DataFrame:
    """direction, images and share of a scale_profile."""
    sums = profile.groupBy("direction").agg(F.sum("n").alias("images"))
    return sums.withColumn("share", F.col("images") / F.sum("images").over(Window.partitionBy()))


def common_grids(profile: DataFrame, k: int = 8) -> DataFrame:
    """rows, cols, images and share of the k most common grids."""
    sums = profile.groupBy("rows", "cols").agg(F.sum("n").alias("images"))
    total = F.sum("images").over(Window.partitionBy())
    return sums.withColumn("share", F.col("images") / total).orderBy(F.desc("images"), "rows", "cols").limit(k)


def grid_is_maximal(w: Column, h: Column, rows: Column, cols: Column, patch: int = 16, most: int = 256) -> Column:
    """Whether the grid fits and the next larger one, where the tighter side gains a patch, doesn't."""
    beyond = F.least(rows * patch / h, cols * patch / w) * (1 + 1e-9) + 1e-12
    count = lambda side: F.greatest(F.lit(1), F.ceil(side * beyond / patch))
    return (rows * cols <= most) & (count(h) * count(w) > most)


def dataset_info(df: DataFrame) -> DataFrame:
    """name, type and nullable of every column, nested ones by their paths."""

    def walk(kind, path: str, nullable: bool):
        yield path, kind.simpleString(), nullable
        for f in getattr(kind, "fields", []):
            yield from walk(f.dataType, f"{path}.{f.name}", f.nullable)

    rows = [x for f in df.schema.fields for x in walk(f.dataType, f.name, f.nullable)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")
