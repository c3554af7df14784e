"""5. Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label become one class. Rotations are learned on a bounded sample of classes, so that the signs of the
rotated vectors are balanced binary codes that keep angles. Codes are cut into substrings, each of which indexes a table:
codes that differ in fewer bits than there are tables agree on a substring, and others are likely to. Vectors of one label
that meet in a bucket of a table, and in none of an earlier table, are compared by the exact cosine in double precision.

A substring has about as many bits as the vectors of the largest label have, written as a number, so that buckets don't
grow with the data, and there are as many tables as let a pair at the threshold meet with a chance of 1 - MISS, were bits
independent. Pairs that meet nowhere are links that are lost: of 4,000 pairs of 64 numbers at a cosine of 0.9801, without any
clusters, 99.9% are found, and as many at 0.982 and 0.985.

Buckets are compared in blocks, as products of matrices, which tell how many links each vector has and only those links
that connect something, so that many near copies make no table of pairs. What they compare still grows with the square of
the number of different vectors in a bucket, as links are to be counted.

Vectors that are null, zero, or hold a null or non-finite component, and rows without a label, are components of their own
without links. Rows of equal vectors and labels link with one another. A null vec_id is carried along (component and kept
null, nothing links with it). Vectors of different lengths don't link; for other lengths than the most frequent one the
rotations are random. Rows of one vec_id and different vectors are different vectors, though they share their id. Empty
tables give empty results. Columns other than the three are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot
from .components import components

#: Classes that the rotations are learned on, about.
SAMPLE = 4096
#: Rounds of iterative quantisation.
ROUNDS = 30
#: Bits of a substring, at least, and the chance that a pair at the threshold may meet in no table.
LEAST_BITS, MISS = 8, 0.004
#: Vectors of a block of a bucket, and rows of a part.
BLOCK, PART = 512, 2048


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """A matrix from vectors to bits: the principal directions, rotated so that signs lose least of the projections."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    _, _, axes = np.linalg.svd(sample, full_matrices=False)
    axes = axes[: min(bits, len(axes), dim)].T
    if axes.shape[1] < bits:  # fewer directions than bits: the rest is random
        axes = np.concatenate([axes, rng.standard_normal((dim, bits - axes.shape[1])) / np.sqrt(dim)], 1)
    rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    v = sample @ axes
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    return axes @ rotation


def layout(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for that many vectors of a label."""
    bits = min(48, max(LEAST_BITS, math.ceil(math.log2(max(2, largest))) + 1))
    meet = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, 1 if meet > 1 - MISS else math.ceil(math.log(MISS) / math.log(1 - meet))


def code_matrix(sample: np.ndarray, bits: int) -> np.ndarray:
    """As many rotations of the sample's directions as it takes for so many bits."""
    dim = sample.shape[1]
    return np.concatenate([learn_rotation(sample, dim, seed=i) for i in range(-(-bits // dim))], 1)[:, :bits]


def _codes(matrix: np.ndarray, bits: int, tables: int):
    """class, label, vector, n and the substrings of the vector's code."""
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        matrices = {len(matrix): matrix}
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            keys = np.zeros((len(sizes), tables), np.int64)
            for dim in np.unique(sizes):
                if dim not in matrices:
                    matrices[dim] = np.random.default_rng(int(dim)).standard_normal((dim, tables * bits))
                own = np.flatnonzero(sizes == dim)
                x = np.asarray(vectors.take(pa.array(own)).flatten(), np.float64).reshape(len(own), dim)
                keys[own] = (x @ matrices[dim] > 0).reshape(len(own), tables, bits) @ weights
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "keys"])

    return run


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _linked(x: np.ndarray, keys: np.ndarray, n: np.ndarray, own: np.ndarray | None, table: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many vectors each row is linked with (rows stand for n each), and links that connect the components.

    Pairs that met in an earlier table don't count, nor, where own tells two blocks apart, those within a block.
    """
    size = np.sqrt((x * x).sum(1))
    root, linked, edges = list(range(len(x))), np.zeros(len(x), np.int64), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(0, len(x), 256):
        part = slice(i, i + 256)
        ok = x[part] @ x.T / (size[part][:, None] * size[None, :]) >= threshold
        for s in range(table):
            ok &= keys[part, s][:, None] != keys[None, :, s]
        if own is not None:
            ok &= own[part][:, None] != own[None, :]
        ok[np.arange(len(ok)), i + np.arange(len(ok))] = False
        linked[part] += ok @ n
        for a, b in zip(*np.nonzero(np.triu(ok, i + 1)), strict=True):
            p, q = find(i + int(a)), find(int(b))
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((i + int(a), int(b)))
    return linked, edges


def _compared(threshold: float):
    """For each pair of blocks of a bucket (or one block) in a part: how many links each class has across them, and links that connect their components."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(["class", "n", "own", "label", "dim", "t", "key", "one", "two", "vector", "keys"]).sort_by([(c, "ascending") for c in ("label", "dim", "t", "key", "one", "two", "class")]).combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in ("label", "dim", "t", "key", "one", "two"):
            codes = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        cls, n, own, t, one, two = (rows.column(c).to_numpy() for c in ("class", "n", "own", "t", "one", "two"))
        vectors = rows.column("vector").combine_chunks()
        ends = vectors.offsets.to_numpy()
        flat = np.asarray(vectors.values, np.float64)
        keys = np.asarray(rows.column("keys").combine_chunks().flatten(), np.int64).reshape(rows.num_rows, -1)
        first = np.flatnonzero(new)
        a, b, count = [], [], []
        for p, q in zip(first, [*first[1:], len(cls)], strict=True):
            x = flat[ends[p] : ends[q]].reshape(q - p, -1)
            linked, edges = _linked(x, keys[p:q], n[p:q], own[p:q] if one[p] != two[p] else None, int(t[p]), threshold)
            some = np.flatnonzero(linked)
            a += [cls[p + some], cls[[p + e[0] for e in edges]]]
            b += [np.full(len(some), -1), cls[[p + e[1] for e in edges]]]
            count += [linked[some], np.zeros(len(edges), np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64()), "n": pa.array(np.concatenate(count), pa.int64())})

    return run


def _links(classes: DataFrame, threshold: float, sample: int) -> DataFrame:
    """a, b, n: with b = -1, vectors that class a is linked with by a pair of blocks; else a link between classes a and b."""
    dims = classes.groupBy(F.size("vector").alias("dim"), "label").agg(F.count("*").alias("n"))
    dims = dims.groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
    main = dims.agg(F.max(F.struct("n", "dim")).alias("main"), F.max("largest").alias("largest")).first()
    bits, tables = layout(main["largest"], threshold)
    share = min(1.0, sample / main["main"]["n"])
    chosen = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = classes.where((F.size("vector") == main["main"]["dim"]) & chosen).select("vector").collect() or classes.where(F.size("vector") == main["main"]["dim"]).select("vector").limit(1).collect()
    points = np.array([r["vector"] for r in rows], np.float64)
    matrix = code_matrix(points / np.linalg.norm(points, axis=1, keepdims=True), bits * tables)

    own = classes.select("class", "label", "vector", "n")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    codes = cut(own.mapInArrow(_codes(matrix, bits, tables), f"{kinds}, keys array<bigint>"), "embedding-codes")
    bucket = F.struct("label", F.size("vector").alias("dim"), "t", "key")
    entries = codes.select("class", "label", "vector", F.posexplode("keys").alias("t", "key")).select("class", bucket.alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    full = cut(full.withColumn("entries", F.col("size")), "embedding-buckets")
    met = join_hot(entries, full, "bucket", "entries").groupBy("class").agg(F.collect_list(F.struct("bucket", "size")).alias("buckets"))
    placed = met.join(codes.select("class", "vector", "n", "keys"), "class").select("class", "vector", "n", "keys", F.inline("buckets"))
    placed = placed.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket.*", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "own", "class", "vector", "n", "keys")
    # small buckets go through Python many at a time; a part has PART rows or so, or a pair of full blocks
    travelling = full.agg(F.coalesce(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK)), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("label", "dim", "t", "key", "one", "two"), F.lit(max(1, -(-travelling // PART))))
    return cut(placed.withColumn("part", part).groupBy("part").applyInArrow(_compared(threshold), "a bigint, b bigint, n bigint"), "embedding-links")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector"), (_usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("usable"))
    zero = rows.schema["vector"].dataType.elementType
    whole = F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(zero)).otherwise(x))  # -0 is 0
    members = rows.where("usable").select("vec_id", F.struct("label", whole.alias("vector")).alias("own"))
    classes = members.groupBy("own").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("class"), "own", "own.label", "own.vector", "first", "n"), "embedding-classes")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if classes.isEmpty():
        return alone
    links = _links(classes, threshold, sample)
    linked = links.where("b = -1").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    found = components(links.where("b <> -1").select("a", "b")).withColumnRenamed("id", "class")
    known = classes.join(linked, "class", "left").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    known = cut(known.select("own", "first", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component"), "embedding-known")
    smallest = known.groupBy("component").agg(F.min("first").cast("long").alias("component_id"), F.count("*").alias("classes"))
    known = join_hot(known, cut(smallest, "embedding-smallest"), "component", "classes").select("own", "n", "n_links", "component_id")
    every = join_hot(members, cut(known, "embedding-told"), "own", "n").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return every.unionAll(alone)


def op5_embedding_dedup(spark, sf_dir):
    from .common import table

    return embedding_dedup(table(spark, sf_dir, "embeddings"))
