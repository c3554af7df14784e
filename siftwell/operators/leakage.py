"""Leakage between splits: equal content, similar embeddings, evidence, nearest references, survivors.

Items are rows of (class, split, name, byte_hash, pixel_hash, emb, ok); nothing is compared across classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence, strongest first.
EVIDENCE = ("byte", "pixel", "siglip")
#: Rows of a block of embeddings.
BLOCK = 1024
#: Blocks a side of a square of blocks that travels as one.
SIDE = 4
#: Numbers of a vector that are columns at most.
COLUMNS = 256


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_pairs(train: DataFrame, val: DataFrame) -> DataFrame:
    """class, train_image, val_image, match_type: every pair of equal pixel hashes; byte if the bytes are equal too."""
    t = train.where("pixel_hash is not null").select("class", "pixel_hash", F.col("name").alias("train_image"), F.col("byte_hash").alias("byte_t"))
    v = val.where("pixel_hash is not null").select("class", "pixel_hash", F.col("name").alias("val_image"), F.col("byte_hash").alias("byte_v"))
    kind = F.when(F.col("byte_t") == F.col("byte_v"), "byte").otherwise("pixel")
    return t.join(v, ["class", "pixel_hash"]).select("class", "train_image", "val_image", kind.alias("match_type"))


def duplicates_within(items: DataFrame) -> DataFrame:
    """class, split and surplus: rows beyond the first of each pixel hash."""
    groups = items.where("pixel_hash is not null").groupBy("class", "split", "pixel_hash").agg(F.count("*").alias("n"))
    return groups.groupBy("class", "split").agg(F.sum(F.col("n") - 1).alias("surplus"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _numbered(train: DataFrame, val: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Readable rows of both sides with left_at or right_at, their block of about so many rows of a class, and lefts and rights, how many there are.

    lefts and rights, a row for each class, are counted at once and broadcast. Where the class is a constant the join has no
    key; unless adaptive execution mends it, it would be a product of partitions, with tasks by the hundred thousand.
    """
    marked = lambda df, left: df.where("ok").select("class", F.lit(left).alias("left"))
    blocks = lambda own, name: F.ceil(F.count_if(own) / rows).cast("int").alias(name)
    counts = marked(train, True).unionByName(marked(val, False)).groupBy("class").agg(blocks(F.col("left"), "lefts"), blocks(~F.col("left"), "rights")).where("lefts > 0 and rights > 0")
    placed = lambda df, own: df.where("ok").join(F.broadcast(counts), "class").withColumn(f"{own}_at", F.pmod(F.xxhash64("name"), F.col(f"{own}s")).cast("int"))
    return placed(train, "left"), placed(val, "right")


def _block_pairs(train: DataFrame, val: DataFrame, rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """class, left, right: readable rows (name, emb and extra ones of val) in blocks of about so many of a class, each block of train with each of val.

    A pair of blocks is a key of its own, so that a large class is dealt over as many tasks as it has pairs. Neither side is
    broadcast or gathered as a whole; a block travels once for each block of the other side, as all pairs ask for. The join
    is a merge join by a hint: what adaptive execution knows of a side's size is from before its blocks are repeated, and a
    side that looks small would be sent to the driver with all its repeats, to be broadcast.
    """

    def gathered(placed: DataFrame, own: str, cols: tuple[str, ...]) -> DataFrame:
        return placed.groupBy("class", f"{own}_at", "lefts", "rights").agg(F.collect_list(F.struct(*cols)).alias(own))

    left, right = _numbered(train, val, rows)
    a = gathered(left, "left", ("name", "emb")).withColumn("right_at", _every("rights")).select("class", "left_at", "right_at", "left")
    b = gathered(right, "right", ("name", "emb", *extra)).withColumn("left_at", _every("lefts")).select("class", "left_at", "right_at", "right")
    return a.hint("merge").join(b, ["class", "left_at", "right_at"]).select("class", "left", "right")


def _scores(left: list[dict], right: list[dict]) -> np.ndarray:
    return np.array([r["emb"] for r in left], np.float64) @ np.array([r["emb"] for r in right], np.float64).T


def _parts(rows: pa.StructArray, size: int) -> list[tuple[pa.Array, np.ndarray]]:
    """Names and vectors in double precision, so many rows each. Numbers go straight from Arrow to numpy."""
    out = []
    for at in range(0, len(rows), size):
        names, vectors = (rows.slice(at, size).field(c) for c in ("name", "emb"))
        lengths = pc.unique(pc.list_value_length(vectors))
        if len(lengths) != 1 or vectors.null_count:
            raise ValueError("readable vectors must be of one length")
        out.append((names.cast(pa.string()), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), lengths[0].as_py())))
    return out


def _similar(threshold: float, block: int):
    def run(batches):
        for batch in batches:
            kind = batch.schema.field("class").type
            for cls, lefts, rights in zip(*(batch.column(c) for c in ("class", "left", "right")), strict=True):
                others = _parts(rights.values, block)
                for left, a in _parts(lefts.values, block):
                    for right, b in others:
                        scores = a @ b.T
                        i, j = np.nonzero(scores > threshold)
                        if len(i):
                            yield pa.RecordBatch.from_pydict({"class": pa.array([cls.as_py()] * len(i), kind), "train_image": left.take(pa.array(i)), "val_image": right.take(pa.array(j)), "cosine_sim": pa.array(scores[i, j], pa.float64())})

    return run


def cosine_pairs(train: DataFrame, val: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """class, train_image, val_image, cosine_sim of all pairs above the threshold; unreadable rows (ok false) have none.

    Each pair of blocks of a class is one matrix product; blocks travel in squares of SIDE by SIDE, so that a row is sent
    for each square rather than for each block of the other side.
    """
    kind = train.schema["class"].dataType.simpleString()
    return _block_pairs(train, val, block * SIDE).mapInArrow(_similar(threshold, block), f"class {kind}, train_image string, val_image string, cosine_sim double")


def cosine_pairs_sql(train: DataFrame, val: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """The same pairs by built-in functions: the rows of a pair of blocks meet in a merge join (see _block_pairs), whose condition is their product.

    Vectors of up to COLUMNS numbers are columns in it, as the product of columns is compiled and that of arrays isn't.
    How many there are is looked up before. Rows of different lengths have no product, nor have those with a null among
    their numbers: they are left out, so that no column can be null.
    """
    long = lambda df: df.where("ok").agg(F.max(F.size("emb"))).first()[0] or 0
    width = min(long(train), long(val))
    wide = width > COLUMNS

    def side(placed: DataFrame, own: str, image: str, other: str) -> DataFrame:
        at = lambda i: F.coalesce(F.get("emb", F.lit(i)).cast("double"), F.lit(0.0))
        vector = [F.col("emb").alias(own)] if wide else [at(i).alias(f"{own}{i}") for i in range(width)]
        sized = placed.where(~F.exists("emb", F.isnull)).withColumn("size", F.size("emb")).select("class", f"{own}_at", _every(f"{other}s").alias(f"{other}_at"), "size", F.col("name").alias(image), "emb")
        return sized.select("class", "left_at", "right_at", "size", image, *vector)

    left, right = _numbered(train, val, block)
    pairs = side(left, "left", "train_image", "right").hint("merge").join(side(right, "right", "val_image", "left"), ["class", "left_at", "right_at", "size"])
    terms = [F.col(f"left{i}") * F.col(f"right{i}") for i in range(0 if wide else width)]
    sums = [sum(terms[i : i + 16], F.lit(0.0)) for i in range(0, len(terms), 16)]  # of few terms, so that the tree stays low
    product = dot(F.col("left"), F.col("right")) if wide else sum(sums, F.lit(0.0))
    return pairs.select("class", "train_image", "val_image", product.alias("cosine_sim")).where(F.col("cosine_sim") > threshold)


def backfilled(pairs: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """pairs with cosine_sim; an unreadable side counts as a zero vector. Vectors meet in merge joins, so that none pass the driver."""
    side = lambda df, image, emb: df.select("class", F.col("name").alias(image), F.when(F.col("ok"), F.col("emb")).alias(emb)).hint("merge")
    joined = pairs.join(side(train, "train_image", "a"), ["class", "train_image"], "left").join(side(val, "val_image", "b"), ["class", "val_image"], "left")
    return joined.withColumn("cosine_sim", F.coalesce(dot(F.col("a"), F.col("b")), F.lit(0.0))).drop("a", "b")


def merged_evidence(exact: DataFrame, similar: DataFrame) -> DataFrame:
    """One row for each pair of either side; exact evidence wins. exact may have no cosine_sim (the check was left out)."""
    keys = ["class", "train_image", "val_image"]
    left = exact.select(*keys, "match_type", *(["cosine_sim"] if "cosine_sim" in exact.columns else [F.lit(None).cast("double").alias("cosine_sim")]))
    both = left.join(similar.withColumnRenamed("cosine_sim", "found"), keys, "full")
    return both.select(*keys, F.coalesce("match_type", F.lit("siglip")).alias("match_type"), F.coalesce("cosine_sim", "found").alias("cosine_sim"))


def sorted_leaks(leaks: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, EVIDENCE)), F.col("match_type"))
    return leaks.orderBy(rank, F.coalesce("cosine_sim", F.lit(0.0)).desc(), "train_image", "val_image")


def leak_summary(leaks: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("match_type") == kind).alias(kind)
    return leaks.groupBy("class").agg(*map(of, EVIDENCE), F.count_distinct("train_image").alias("train_images"), F.count_distinct("val_image").alias("val_images"))


def leak_lines(leaks: DataFrame) -> DataFrame:
    """What the report file holds, as text."""
    cosine = F.when(F.col("cosine_sim").isNull(), "").otherwise(F.format_string("%.6f", F.col("cosine_sim")))
    return leaks.select("class", "match_type", cosine.alias("cosine_sim"), "train_image", "val_image")


def _best(splits: tuple[str, ...]):
    """For each row of the left block, the nearest row of each split in the right block; of equal ones, that of the first name."""

    def run(batches):
        for batch in batches:
            for cls, left, right in zip(*(batch.column(c).to_pylist() for c in ("class", "left", "right")), strict=True):
                right = sorted(right, key=lambda r: r["name"])
                scores = _scores(left, right)
                out = []
                for place, split in enumerate(splits):
                    own = np.array([k for k, r in enumerate(right) if r["split"] == split], np.int64)
                    if len(own):
                        top = own[scores[:, own].argmax(1)]
                        out += [(a["name"], float(scores[i, k]), place, right[k]["name"], split) for i, (a, k) in enumerate(zip(left, top, strict=True))]
                names = ("train_image", "cos", "place", "matched_image", "matched_split")
                kinds = (pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([cls] * len(out), batch.schema.field("class").type), *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], names=["class", *names])

    return run


def nearest(train: DataFrame, references: DataFrame, splits: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """class, train_image, cosine_sim, matched_image, matched_split, best_<split> of every train row.

    references has a split; ties go to the first split named, then the first name. Without a readable vector on either
    side the cosine is -1 and nothing is matched.
    """
    kind = train.schema["class"].dataType.simpleString()
    pairs = _block_pairs(train, references, block, ("split",))
    best = pairs.mapInArrow(_best(splits), f"class {kind}, train_image string, cos double, place int, matched_image string, matched_split string")
    top = F.min(F.struct((-F.col("cos")).alias("minus"), "place", "matched_image", "matched_split"))
    found = best.groupBy("class", "train_image").agg(top.alias("best"), *[F.max(F.when(F.col("matched_split") == s, F.col("cos"))).alias(f"best_{s}") for s in splits])
    found = found.select("class", "train_image", (-F.col("best.minus")).alias("cosine_sim"), "best.matched_image", "best.matched_split", *[f"best_{s}" for s in splits])
    every = train.select("class", F.col("name").alias("train_image")).join(found, ["class", "train_image"], "left")
    return every.na.fill(-1.0, ["cosine_sim", *[f"best_{s}" for s in splits]])


def flagged(near: DataFrame, threshold: float) -> DataFrame:
    return near.where(F.col("cosine_sim") > threshold)


def survivors(train: DataFrame, flags: DataFrame) -> DataFrame:
    """The train rows that stay; unreadable ones do. Nothing is deleted."""
    return train.join(flags.select("class", F.col("train_image").alias("name")), ["class", "name"], "left_anti")


def removal_summary(near: DataFrame, threshold: float, splits: tuple[str, ...]) -> DataFrame:
    hit = lambda s: F.col(f"best_{s}") > threshold
    every = hit(splits[0])
    for s in splits[1:]:
        every = every & hit(s)
    flag = F.col("cosine_sim") > threshold
    return near.groupBy("class").agg(F.count("*").alias("train_images"), F.count_if(flag).alias("flagged"), *[F.count_if(hit(s)).alias(f"hits_{s}") for s in splits], F.count_if(every).alias("hits_all"), F.avg(flag.cast("double")).alias("proportion"))


def cache_split(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Embeddings that a cache (name, emb, ok) has, and the items still to be embedded."""
    return cache.join(items.select("name"), "name", "left_semi"), items.join(cache.select("name"), "name", "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def sorted_removals(flags: DataFrame) -> DataFrame:
    """Flagged rows, most similar first; of equal ones by name."""
    return flags.orderBy(F.desc("cosine_sim"), "class", "train_image")


def removal_lines(flags: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """What the file of removals holds, as text: a column for the best of each split."""
    show = lambda c: F.format_string("%.6f", F.col(c)).alias(c)
    return sorted_removals(flags).select("class", "train_image", show("cosine_sim"), "matched_image", "matched_split", *[show(f"best_{s}") for s in splits])


def guarded_deletes(flags: DataFrame, folder: str, unsafe: bool = False) -> DataFrame:
    """path and status of the files that flags name under a folder whose name must say "toremove", unless unsafe. Nothing is deleted: whoever runs it decides.

    Names that would leave the folder are refused.
    """
    if "toremove" not in folder.rstrip("/").rpartition("/")[2] and not unsafe:
        raise ValueError(f"{folder} isn't marked as one to remove from")
    outside = F.startswith("train_image", F.lit("/")) | F.array_contains(F.split("train_image", "/"), "..")
    return flags.select(F.concat(F.lit(folder.rstrip("/") + "/"), "train_image").alias("path"), F.when(outside, "refused").otherwise("to delete").alias("status"))


def both_hashes(files: DataFrame, pixels) -> DataFrame:
    """files (name, content) with byte_hash, pixel_hash and ok. pixels gives a picture's bytes, as (width, height, raw bytes), or fails.

    The pixel hash tells the size and the pixels, whatever they are coded in; a content that can't be read has none.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                try:
                    width, height, raw = pixels(content)
                    out.append(hashlib.sha256(f"{width}x{height}:".encode() + bytes(raw)).hexdigest())
                except Exception:  # unreadable
                    out.append(None)
            yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "byte_hash": batch.column("byte_hash"), "pixel_hash": pa.array(out, pa.string()), "ok": pa.array([x is not None for x in out])})

    rows = files.select("name", "content", content_hash(F.col("content")).alias("byte_hash"))
    return rows.mapInArrow(run, "name string, byte_hash string, pixel_hash string, ok boolean")


def hash_groups(items: DataFrame) -> DataFrame:
    """pixel_hash and the names that have it, sorted."""
    return items.where("pixel_hash is not null").groupBy("pixel_hash").agg(F.sort_array(F.collect_list("name")).alias("names"))


def removal(train: DataFrame, references: DataFrame, threshold: float, splits: tuple[str, ...]) -> dict[str, DataFrame]:
    """The whole job for all classes at once: nearest references, what is flagged, what stays, and the summary of each class."""
    near = nearest(train, references, splits)
    flags = flagged(near, threshold)
    return {"nearest": near, "removed": removal_lines(flags, splits), "survivors": survivors(train, flags), "summary": removal_summary(near, threshold, splits)}
