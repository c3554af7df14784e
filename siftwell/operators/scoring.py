"""Scores of binary classifiers: any scorer as a map over Arrow batches, a logistic baseline, forward passes of small heads."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def scored(samples: DataFrame, scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], emb: str = "emb") -> DataFrame:
    """samples with prob. scorer builds, once for each task, a function from a matrix of embeddings to probabilities."""

    def run(batches):
        score = scorer()
        for batch in batches:
            x = np.array(batch.column(emb).to_pylist(), np.float64) if batch.num_rows else np.zeros((0, 1))
            prob = score(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"prob": pa.array(prob, pa.float64())})

    keep = [c for c in samples.columns if c != emb]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema if f.name in keep)
    return samples.mapInArrow(run, f"{schema}, prob double")


def logistic_baseline(samples: DataFrame, emb: str = "emb", label: str = "label", reg: float = 0.01) -> Callable:
    """A scorer from a logistic regression that Spark fits on embeddings."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    model = LogisticRegression(regParam=reg).fit(samples.select(array_to_vector(samples[emb].cast("array<double>")).alias("features"), samples[label].cast("double").alias("label")))
    w, b = model.coefficients.toArray(), model.intercept
    return lambda: lambda x: 1 / (1 + np.exp(-(x @ w + b)))


def lora(x: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """A linear layer with a low-rank addition scaled by alpha / rank."""
    return x @ w.T + (x @ a.T) @ b.T * (alpha / a.shape[0])


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def mlp(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear layers with GELU between them."""
    for i, (w, b) in enumerate(layers):
        x = x @ w.T + b
        x = gelu(x) if i + 1 < len(layers) else x
    return x
