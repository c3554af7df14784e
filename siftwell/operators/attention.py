"""Attention vectors on patch grids: (image, rows, cols, attn) with attn an array over tokens, padding last."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(images: DataFrame) -> DataFrame:
    """One row for each real patch: token, row, col, ring (distance to the nearest edge), score."""
    each = images.select("image", "rows", "cols", F.posexplode("attn").alias("token", "score")).where(F.col("token") < F.col("rows") * F.col("cols"))
    each = each.withColumns({"row": F.floor(F.col("token") / F.col("cols")).cast("int"), "col": F.col("token") % F.col("cols")})
    ring = F.least("row", F.col("rows") - 1 - F.col("row"), "col", F.col("cols") - 1 - F.col("col"))
    return each.withColumn("ring", ring)


def top_patches(images: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "token"))
    return cells(images).withColumn("rank", rank).where(F.col("rank") <= k).select("image", "rank", "token", "row", "col", "score")


def ring_mass(images: DataFrame, ring: int = 0) -> DataFrame:
    """image, mass: the attention on a ring, and share: that ring's share of the patches."""
    on = F.col("ring") == ring
    return cells(images).groupBy("image").agg(F.sum(F.when(on, F.col("score")).otherwise(0.0)).alias("mass"), F.avg(on.cast("double")).alias("share"))


def without_border(images: DataFrame, rings: int = 1) -> DataFrame:
    """Attention inside the outer rings alone, scaled to sum up to 1."""
    inner = cells(images).where(F.col("ring") >= rings)
    return inner.withColumn("score", F.col("score") / F.sum("score").over(Window.partitionBy("image")))


def mean_attention(heads: DataFrame) -> DataFrame:
    """image, token, score: the mean over heads (and queries or layers) of rows (image, attn)."""
    return heads.select("image", F.posexplode("attn").alias("token", "score")).groupBy("image", "token").agg(F.avg("score").alias("score"))


def layer_table(shares: DataFrame, layers: list[int]) -> DataFrame:
    """Mean ring share by label (rows) and layer (columns) of rows (label, layer, mass)."""
    return shares.groupBy("label").pivot("layer", layers).agg(F.avg("mass"))


def patch_box(row: Column, col: Column, rows: Column, cols: Column, width: Column, height: Column) -> Column:
    """struct(l, t, r, b): the pixels of an image that belong to a patch under nearest resizing."""
    edge = lambda i, n, size: F.ceil(i * size / n).cast("int")
    return F.struct(edge(col, cols, width).alias("l"), edge(row, rows, height).alias("t"), edge(col + 1, cols, width).alias("r"), edge(row + 1, rows, height).alias("b"))


def softmax_attention(q: np.ndarray, k: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Weights (heads, queries, keys) of scaled dot products; masked keys get none."""
    scores = np.einsum("hqd,hkd->hqk", q, k) / np.sqrt(q.shape[-1])
    if mask is not None:
        scores = np.where(mask[None, None, :], scores, -np.inf)
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def rollout(layers: list[np.ndarray]) -> np.ndarray:
    """Layers' (tokens, tokens) weights chained, each half replaced by the identity and its rows scaled to 1."""
    out = None
    for a in layers:
        a = (a + np.eye(len(a))) / 2
        a = a / a.sum(-1, keepdims=True)
        out = a if out is None else a @ out
    return out


def received(weights: DataFrame, tokens: int, how: str = "mean") -> DataFrame:
    """image, attn: what every token receives, from rows (image, weights) of layers x tokens x tokens numbers in one array."""

    def run(batches):
        for batch in batches:
            out = []
            for flat in batch.column("weights").to_pylist():
                a = np.array(flat, np.float64).reshape(-1, tokens, tokens)
                whole = rollout(list(a)) if how == "rollout" else a.mean(0)
                out.append(whole.mean(0).tolist())
            yield pa.RecordBatch.from_pydict({"image": batch.column("image"), "attn": pa.array(out, pa.list_(pa.float64()))})

    kind = weights.schema["image"].dataType.simpleString()
    return weights.select("image", "weights").mapInArrow(run, f"image {kind}, attn array<double>")


def pair_rows(pairs: DataFrame, plans: DataFrame) -> DataFrame:
    """stem, label, path, variant, steps: both images of every pair (stem, real, fake) under every variant (stem, variant, steps) of the pair."""
    sides = F.array(F.struct(F.lit(0).alias("label"), F.col("real").alias("path")), F.struct(F.lit(1).alias("label"), F.col("fake").alias("path")))
    return pairs.select("stem", F.inline(sides)).join(plans, "stem")


def pair_summary(scored: DataFrame) -> DataFrame:
    """The lines of the summary of scored images (stem, label, variant, plan, rows, cols, prob, attn): top patch, attention on the border."""
    cell = cells(scored.withColumn("image", F.struct("stem", "label", "variant")))
    best = cell.groupBy("image").agg(F.max("score").alias("attn_max"), F.min_by("token", F.struct((-F.col("score")).alias("minus"), "token")).alias("top_token"))
    edge = ring_mass(scored.withColumn("image", F.struct("stem", "label", "variant")))
    told = scored.select(F.struct("stem", "label", "variant").alias("image"), "plan", "rows", "cols", "prob").join(best, "image").join(edge, "image")
    show = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    return told.select("image.*", "plan", F.col("rows").alias("grid_h"), F.col("cols").alias("grid_w"), show("prob", 6).alias("p_ai"), show("attn_max", 6).alias("attn_max"), "top_token", F.floor(F.col("top_token") / F.col("cols")).cast("int").alias("top_row"), (F.col("top_token") % F.col("cols")).alias("top_col"), show("mass", 4).alias("border_mass"), show("share", 4).alias("border_share"))


def pair_stats(summary: DataFrame) -> DataFrame:
    """label, variants, p_ai, border_mass and border_share: means over the lines of a summary."""
    return summary.groupBy("label").agg(F.count("*").alias("variants"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("p_ai", "border_mass", "border_share")])


def matching(files: DataFrame, part: str) -> DataFrame:
    """Files whose name holds a text; an empty text leaves all."""
    return files.where(F.contains("name", F.lit(part))) if part else files
