"""Connected components of a table of links, by rounds of joins, without collecting anything."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, done, join_hot

#: Links that one task takes to their components at once; more are brought down by rounds first.
ALONE = 1 << 20


def _contract(batches):
    """Replaces the links of a task by stars around the smallest id of each component they form."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    leaves = [x for x in root if root[x] != x]
    for i in range(0, len(leaves), 1 << 16):
        part = leaves[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["a", "b"])


def _contracted(links: DataFrame) -> DataFrame:
    """Links (a < b) of the same components: what each task holds becomes stars."""
    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "a bigint, b bigint")


def _whole(batches):
    """Every id and its component, of all links at once: the larger of two linked roots goes below the smaller, until none are linked."""
    found = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if not found:
        return
    n = sum(len(a) for a, _ in found)
    ids, at = np.unique(np.concatenate([a for a, _ in found] + [b for _, b in found]), return_inverse=True)
    a, b, root = at[:n], at[n:], np.arange(len(ids))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    for i in range(0, len(ids), 1 << 16):
        part = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[root[part]])], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that links reach) of every id in links (a, b).

    Links are contracted where they lie; up to ALONE of them one task takes to the end. While there are more, rounds bring
    them down, as every round is some fifteen stages, whose plans and tasks the driver keeps account of.

    Each round takes every node to the smallest neighbour of itself and of its neighbours (a node's larger neighbours are
    linked to its smallest one, then its smaller ones likewise), which keeps components together and shortens paths; what a
    task holds is contracted on the way. It ends when a round changes nothing: the links are stars around the smallest ids.
    """
    digest = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = cut(_contracted(links).distinct(), "links")
    was = digest(edges)
    while True:
        if was[0] <= ALONE:
            found = cut(edges.coalesce(1).mapInArrow(_whole, "id bigint, component bigint"), "links")
            done(edges)
            return found
        # neighbours of hubs, which stars have, stay where they are
        total = 2 * was[0]
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, "a", "n", total=total).where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, "a", "n", total=total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"), F.col("m").alias("a"))
        last, edges = edges, cut(_contracted(small).distinct(), "links")
        done(last)
        now = digest(edges)
        if now == was:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        was = now
