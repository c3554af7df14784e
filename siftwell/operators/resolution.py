"""Resolutions far from those of a reference set: shares within a distance, radius, grid of settings, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log2_distance, seeded_order, strip_augmented

#: Distinct resolutions of a reference up to which they are broadcast: 1,000,000 of 24 bytes are some 24 MB.
BROADCAST_RESOLUTIONS = 1_000_000
#: Resolutions of a block where there are more.
BLOCK = 4096
# Settings of the grid.
TOLERANCES = (0.1, 0.15, 0.2, 0.25, 0.3, 0.4)
SHARES = (0.001, 0.002, 0.005, 0.01, 0.02)


def histogram(headers: DataFrame) -> DataFrame:
    return headers.groupBy("width", "height").agg(F.count("*").alias("n"))


def _distances(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """width, height, ref_n, d of every pair of distinct resolutions: both are histograms, not images.

    Few references are broadcast; of many, each block meets each block of candidates under a key of its own.
    """
    pairs = candidates.select("width", "height").distinct()
    ref = reference.select(F.col("width").alias("rw"), F.col("height").alias("rh"), F.col("n").alias("ref_n"))
    known = reference.count()
    if known <= BROADCAST_RESOLUTIONS:
        both = pairs.crossJoin(F.broadcast(ref))
    else:
        lefts, rights = (-(-n // BLOCK) for n in (pairs.count(), known))
        own = lambda a, b, n: F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = pairs.withColumn("left", own("width", "height", max(1, lefts))).withColumn("right", every(rights))
        both = left.join(ref.withColumn("right", own("rw", "rh", rights)).withColumn("left", every(max(1, lefts))), ["left", "right"])
    return both.select("width", "height", "ref_n", log2_distance(F.col("width"), F.col("height"), F.col("rw"), F.col("rh")).alias("d"))


def reference_shares(candidates: DataFrame, reference: DataFrame, tolerances=TOLERANCES) -> DataFrame:
    """width, height, tol, share: of the reference images, those within tol of each candidate resolution (inclusive)."""
    pairs = _distances(candidates, reference)
    total = F.sum("ref_n")
    wide = pairs.groupBy("width", "height").agg(*[(F.coalesce(F.sum(F.when(F.col("d") <= t, F.col("ref_n"))), F.lit(0)) / total).alias(f"s{i}") for i, t in enumerate(tolerances)])
    return wide.select("width", "height", F.inline(F.array(*[F.struct(F.lit(t).alias("tol"), F.col(f"s{i}").alias("share")) for i, t in enumerate(tolerances)])))


def radius(candidates: DataFrame, reference: DataFrame, max_share: float) -> DataFrame:
    """width, height, radius: the distance at which a neighbourhood first holds more than max_share of the reference."""
    steps = _distances(candidates, reference).groupBy("width", "height", "d").agg(F.sum("ref_n").alias("n"))
    here = Window.partitionBy("width", "height")
    steps = steps.withColumn("share", F.sum("n").over(here.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(here))
    return steps.where(F.col("share") > max_share).groupBy("width", "height").agg(F.min("d").alias("radius"))


def guard_pool(tol: float, share: float, pool_tol: float, pool_share: float) -> None:
    """A criterion looser than the stored pool's would miss images that were never stored."""
    if tol < pool_tol or share > pool_share:
        raise ValueError(f"tol {tol} and share {share} are looser than the pool's {pool_tol} and {pool_share}: scan again")


def used_stems(files: DataFrame) -> DataFrame:
    """Distinct stems of files, without the mark of augmented ones."""
    return files.select(strip_augmented(F.col("stem")).alias("stem")).distinct()


def qualified(images: DataFrame, shares: DataFrame, radii: DataFrame, used: DataFrame, max_share: float) -> DataFrame:
    """images with share, radius, excluded, qualifying and eligible; shares are those of one tolerance, joined by resolution."""
    mark = used.select("stem", F.lit(True).alias("was_used"))
    out = images.join(shares.select("width", "height", "share"), ["width", "height"]).join(radii, ["width", "height"]).join(mark, "stem", "left")
    out = out.withColumn("excluded", F.coalesce("was_used", F.lit(False))).drop("was_used")
    out = out.withColumn("qualifying", F.col("share") <= max_share)
    return out.withColumn("eligible", F.col("qualifying") & ~F.col("excluded"))


def qualification_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("excluded").alias("excluded"), F.count_if("qualifying").alias("qualifying"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & ~F.col("pooled")).alias("eligible_not_pooled"))


def setting_grid(images: DataFrame, shares: DataFrame, used: DataFrame, max_shares=SHARES) -> DataFrame:
    """tol, max_share, images: what every other setting would give after the exclusions."""
    left = images.join(used, "stem", "left_anti").groupBy("width", "height").agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*map(F.lit, max_shares)))
    each = left.join(shares, ["width", "height"]).withColumn("max_share", grid)
    return each.groupBy("tol", "max_share").agg(F.coalesce(F.sum(F.when(F.col("share") <= F.col("max_share"), F.col("n"))), F.lit(0)).alias("images"))


def chosen(rows: DataFrame, n: int, seed: int, farthest: bool = False) -> DataFrame:
    """n of the eligible pooled images: by a seeded shuffle, or by radius with the shuffle for ties."""
    order = [seeded_order(seed, F.col("stem")), F.col("stem")]
    return rows.where("eligible and pooled").orderBy(*([F.desc("radius")] if farthest else []), *order).limit(n)


def manifest(rows: DataFrame) -> DataFrame:
    """The lines of the manifest, numbers as text."""
    return rows.select("stem", "width", "height", F.format_string("%.6f", "share").alias("ref_share"), F.format_string("%.4f", "radius").alias("radius"), F.lit("planned").alias("status"))


def pooled(images: DataFrame, shares: DataFrame, max_share: float) -> DataFrame:
    """images with pooled: whether at most max_share of the reference lies near. Told once for each distinct resolution (shares of one tolerance) and joined back."""
    flags = shares.select("width", "height", (F.col("share") <= max_share).alias("pooled"))
    return images.join(flags, ["width", "height"], "left").na.fill(False, ["pooled"])
