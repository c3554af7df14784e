"""Forward passes of attention heads on stored tokens, with numpy. Weights are dicts of arrays; none are shipped.

A block holds norm (weight, bias), for cross-attention norm_x too, q, k, v and the two layers of its feed-forward part as
(weight, bias). Tokens are arrays (batch, tokens, width); a mask (batch, tokens) is true at real tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scoring import gelu, mlp


def layer_norm(x: np.ndarray, norm: tuple[np.ndarray, np.ndarray], eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * norm[0] + norm[1]


def linear(x: np.ndarray, layer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return x @ layer[0].T + layer[1]


def weights_of(q: np.ndarray, k: np.ndarray, heads: int, mask: np.ndarray | None = None) -> np.ndarray:
    """(batch, heads, queries, keys): softmax of scaled products; masked keys get none."""
    split = lambda x: x.reshape(*x.shape[:2], heads, -1)
    scores = np.einsum("bqhd,bkhd->bhqk", split(q), split(k)) / np.sqrt(q.shape[-1] // heads)
    scores = scores if mask is None else np.where(mask[:, None, None, :], scores, -np.inf)
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def attention_block(x: np.ndarray, block: dict, heads: int, context: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x plus the feed-forward part of what it reads from context (from itself, if none is given), and the weights it read with."""
    own = layer_norm(x, block["norm"])
    read = own if context is None else layer_norm(context, block["norm_x"])
    weights = weights_of(linear(own, block["q"]), linear(read, block["k"]), heads, mask)
    values = linear(read, block["v"]).reshape(*read.shape[:2], heads, -1)
    out = np.einsum("bhqk,bkhd->bqhd", weights, values).reshape(x.shape)
    return x + linear(gelu(linear(out, block["up"])), block["down"]), weights


def qformer(x: np.ndarray, latents: np.ndarray, blocks: list[dict], heads: int, every: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Latents after all blocks, and the weights of the last read. Every so many blocks the latents read the tokens; the others let tokens read one another."""
    if len(blocks) % every:
        raise ValueError("the last block must be one in which the latents read")
    q = np.broadcast_to(latents, (len(x), *latents.shape))
    weights = np.zeros(0)
    for i, block in enumerate(blocks, 1):
        if i % every:
            x, _ = attention_block(x, block, heads, None, mask)
        else:
            q, weights = attention_block(q, block, heads, x, mask)
    return q, weights


def tokens_of(features: dict[str, np.ndarray], weights: dict, clip: float = 8.0, floor: float = 1e-3) -> np.ndarray:
    """(batch, patches x families + 1, width): tokens of forensic features.

    features has (batch, patches, n) for each family, "global" (batch, n), "patch_meta" and, optionally, "valid" (batch);
    rows that aren't valid give the mask token. weights has stats (mean, std), projections (norm, up, down) and kinds (an
    array for each family, the global one last), meta, mask and norm.
    """
    families = [f for f in weights["projections"] if f != "global"]
    missing = [f for f in weights["projections"] if f not in weights["stats"]]
    if missing:
        raise KeyError(f"no statistics for {', '.join(missing)}")

    def projected(f: str) -> np.ndarray:
        mean, std = weights["stats"][f]
        if np.shape(mean) != features[f].shape[-1:]:
            raise ValueError(f"{f} has {features[f].shape[-1]} numbers, its statistics {np.shape(mean)}")
        z = np.clip((features[f] - mean) / np.maximum(std, floor), -clip, clip)
        norm, up, down = weights["projections"][f]
        return linear(gelu(linear(layer_norm(z, norm), up)), down)

    meta = linear(features["patch_meta"], weights["meta"])
    valid = np.asarray(features.get("valid", np.ones(len(meta)))).reshape(-1, 1, 1)
    kinds = weights["kinds"]
    parts = [valid * (projected(f) + kinds[i] + meta) + (1 - valid) * (weights["mask"] + kinds[i]) for i, f in enumerate(families)]
    parts.append(valid * (projected("global")[:, None] + kinds[-1]) + (1 - valid) * (weights["mask"] + kinds[-1]))
    return layer_norm(np.concatenate(parts, 1), weights["norm"])


def detector(weights: dict):
    """A function from tokens and a mask to probabilities and the patch weights of the last read (mean over heads and latents)."""

    def run(x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        latents, read = qformer(x, weights["latents"], weights["blocks"], weights["heads"], weights["every"], mask)
        logits = mlp(latents.mean(1), weights["head"])[:, 0]
        return 1 / (1 + np.exp(-logits)), read.mean((1, 2))

    return run


def checked_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, out: np.ndarray, heads: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights told anew from stored queries and keys, and how far they, applied to the values, are from what the model gave (relative)."""
    weights = weights_of(q, k, heads, mask)
    again = np.einsum("bhqk,bkhd->bqhd", weights, v.reshape(*v.shape[:2], heads, -1)).reshape(out.shape)
    return weights, float(np.abs(again - out).max() / max(np.abs(out).max(), 1e-12))


def detected(samples: DataFrame, build, width: int) -> DataFrame:
    """samples (tokens: an array of tokens x width numbers) with prob and attn. build gives, once for each task, a detector.

    Rows of one number of tokens go through together.
    """
    keep = [c for c in samples.columns if c != "tokens"]

    def run(batches):
        score = build()
        for batch in batches:
            tokens = [np.array(t, np.float64).reshape(-1, width) for t in batch.column("tokens").to_pylist()]
            prob, attn = np.zeros(len(tokens)), [[]] * len(tokens)
            for n in {len(t) for t in tokens}:
                at = [i for i, t in enumerate(tokens) if len(t) == n]
                p, a = score(np.stack([tokens[i] for i in at]))
                for i, x, y in zip(at, p, a, strict=True):
                    prob[i], attn[i] = x, y.tolist()
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"prob": pa.array(prob, pa.float64()), "attn": pa.array(attn, pa.list_(pa.float64()))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema if f.name in keep)
    return samples.mapInArrow(run, f"{schema}, prob double, attn array<double>")


def embedded(images: DataFrame, build, name: str = "path") -> DataFrame:
    """name, emb (of length 1) and ok of rows (name, content). build gives, once for each task, a function from a content to a vector.

    A content that can't be read, or gives no finite vector above 0, is a row without emb and with ok false.
    """

    def run(batches):
        encode = build()
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                try:
                    v = np.asarray(encode(content), np.float64)
                    size = float(np.linalg.norm(v))
                    out.append((v / size).astype(np.float32).tolist() if 0 < size < np.inf else None)
                except Exception:  # unreadable: a row that says so
                    out.append(None)
            yield pa.RecordBatch.from_pydict({name: batch.column(name), "emb": pa.array(out, pa.list_(pa.float32())), "ok": pa.array([v is not None for v in out])})

    return images.select(name, "content").mapInArrow(run, f"`{name}` {images.schema[name].dataType.simpleString()}, emb array<float>, ok boolean")


def _leaves(weights, path: str = ""):
    if isinstance(weights, dict | list | tuple):
        items = weights.items() if isinstance(weights, dict) else enumerate(weights)
        kind = "" if isinstance(weights, dict) else "[]" if isinstance(weights, list) else "()"
        for k, v in items:
            yield from _leaves(v, f"{path}/{k}{kind}")
    else:
        yield path[1:], np.asarray(weights, np.float64)


def write_weights(spark: SparkSession, weights: dict, path: str) -> None:
    """Weights as a table: name, shape and numbers of every array. A name is its path in the dict; lists and tuples are marked."""
    rows = [(name, list(a.shape), a.ravel().tolist()) for name, a in _leaves(weights)]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict:
    """Weights that write_weights has written. A model's weights have to fit in a worker anyway."""
    root: dict = {}
    for r in spark.read.parquet(path).collect():
        a = np.array(r["numbers"]).reshape(r["shape"])
        at, steps = root, r["name"].split("/")
        for step in steps[:-1]:
            at = at.setdefault(step, {})
        at[steps[-1]] = a.item() if not r["shape"] else a

    def built(x):
        if not isinstance(x, dict):
            return int(x) if isinstance(x, float) and x.is_integer() else x
        if any(k.endswith(("[]", "()")) for k in x):
            ordered = [built(x[k]) for k in sorted(x, key=lambda k: int(k[:-2]))]
            return tuple(ordered) if next(iter(x)).endswith("()") else ordered
        return {k: built(v) for k, v in x.items()}

    return built(root)


def is_classical(weights: dict) -> bool:
    """Whether a model reads forensic features too: its weights say how they become tokens."""
    return "projections" in weights or "tokenizer" in weights


def describe(weights: dict) -> str:
    """One line: blocks, latents, heads and how many numbers."""
    n = sum(a.size for _, a in _leaves(weights))
    parts = [f"{len(weights['blocks'])} blocks, latents read every {weights['every']}", f"{len(weights['latents'])} latents of {np.shape(weights['latents'])[-1]}", f"{weights['heads']} heads", f"{n:,} numbers"]
    return ("classical and visual: " if is_classical(weights) else "visual: ") + ", ".join(parts)
