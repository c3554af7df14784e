"""What several of the operators share: reading, shared scratch tables, native regular-expression spans."""

from __future__ import annotations

import atexit
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import ship

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, if driver and executors are one process (tests); else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/siftwell-scratch"


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that a lost executor never repeats what stands above.

    What was shuffled on the way is of no more use then: with free, collections of the driver's garbage let Spark delete it
    at once. The folder goes when the driver ends, or with done().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written[path] = spark
    schema = df.schema
    del df
    for _ in range(2 * free):  # what the first round finds unused may hold more
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def done(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session ended before us, and takes its folder along
            pass


#: Bytes of input, as Spark estimates them, for each part of hashed work.
PART_BYTES = 32 << 20


def buckets(df: DataFrame) -> int:
    """Parts that hashed work over df is dealt into: as many as its bytes ask for, and the session's shuffle partitions at least."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // PART_BYTES)) if size < 1 << 55 else least  # larger ones stand for what Spark knows nothing of


def chunks(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int, max_rows: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of at most max_rows rows and about max_bytes of text (one longer text stands alone), with the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > max_bytes or i - start >= max_rows):
                part = batch.slice(start, i - start)
                yield part, part.column(text).to_pylist()
                start, total = i, 0
            total += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, part.column(text).to_pylist()


#: A span of a text: code points, end exclusive.
SPAN = "struct<start:bigint,end:bigint,text:string>"
#: Entries of a block that a scan folds, and code points of a leaf of a text.
_SCANNED, _LEAF = 128, 256


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once: as the variable of a function, which a column that functions refer to isn't."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _scan_few(x: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(x, F.slice(x, F.lit(1), F.lit(0)), lambda out, v: F.concat(out, F.array(merge(F.coalesce(F.try_element_at(out, F.lit(-1)), zero), v))))


def scan(x: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running results of merge (associative, zero neutral) over an array.

    An array is folded in blocks, as appending to one array copies it each time; then the blocks' last results are folded,
    and merged into the blocks that follow: for n entries some 64 n + (n / 128)^2 / 2 copies.
    """
    last = lambda v: F.greatest(F.ceil(F.size(v) / _SCANNED).cast("int") - 1, F.lit(0))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda b: _scan_few(F.slice(v, b * _SCANNED + 1, F.lit(_SCANNED)), zero, merge))
    ahead = lambda done: lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda y: merge(F.get(done, i - 1), y)))
    tails = lambda own: _scan_few(F.transform(own, lambda b: F.try_element_at(b, F.lit(-1))), zero, merge)
    deep = lambda v: bind(blocks(v), lambda own: bind(tails(own), lambda done: F.flatten(F.transform(own, ahead(done)))))
    return bind(x, lambda v: F.when(F.size(v) <= _SCANNED, _scan_few(v, zero, merge)).otherwise(deep(v)))


def spans_of(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<start,end,text>> of the leftmost non-overlapping matches, by built-in functions alone.

    The text between matches (split) and the matches (regexp_extract_all) come from one regular-expression engine, so
    that the lengths of both, summed, place each match. Null texts and texts for which gate is false have none.
    """
    p = F.lit(pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def placed(pairs: Column) -> Column:
        ends = scan(F.transform(pairs, lambda x: x["gap"] + F.length(x["m"])), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("text")))

    pairs = lambda found: F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("gap")))
    has = F.coalesce(F.regexp_like(text, p), F.lit(False)) if gate is None else F.coalesce(gate & F.regexp_like(text, p), F.lit(False))
    return F.when(has, bind(F.regexp_extract_all(text, p, F.lit(0)), lambda found: bind(pairs(found), placed))).otherwise(none)


def leaves(text: Column) -> Column:
    """A text as an array of runs of _LEAF code points, in which a place is found without counting from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_LEAF}}}"), F.lit(0))


def piece(cut_up: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that leaves() cut up."""
    first = F.floor(start / _LEAF).cast("int")
    over = F.greatest(F.floor((end - 1) / _LEAF).cast("int") - first + 1, F.lit(0))
    joined = F.array_join(F.slice(cut_up, first + 1, over), "")
    return F.substring(joined, (start - first * _LEAF + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def uncovered(spans: Column, covers: Column) -> Column:
    """array<struct<start,end,i>>: the parts of spans (disjoint, by start) that no cover (by start) lies on, and the span's number.

    Covers leave gaps between them; a part starts where a span or a gap does, and ends with the first of both.
    """
    far = F.lit((1 << 62) - 1).cast("long")
    none = F.lit(-1).cast("long")
    event = lambda at, s, g: F.struct(at.alias("at"), s[0].alias("end"), s[1].alias("i"), g.alias("gap_end"))
    of_span = lambda s, i: event(s["start"], (s["end"], i.cast("long")), none)
    reach = lambda c: F.concat(F.array(F.lit(0).cast("long")), scan(F.transform(c, lambda x: x["end"]), F.lit(0).cast("long"), F.greatest))
    starts = F.concat(F.transform(covers, lambda x: x["start"]), F.array(far))
    gaps = F.filter(F.zip_with(reach(covers), starts, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda g: g["start"] < g["end"])
    of_gap = lambda g: event(g["start"], (none, none), g["end"])
    later = lambda a, b: F.struct(b["at"].alias("at"), F.greatest(a["end"], b["end"]).alias("end"), F.greatest(a["i"], b["i"]).alias("i"), F.greatest(a["gap_end"], b["gap_end"]).alias("gap_end"))
    events = F.array_sort(F.concat(F.transform(spans, of_span), F.transform(gaps, of_gap)))
    parts = F.transform(scan(events, event(none, (none, none), none), later), lambda e: F.struct(e["at"].alias("start"), F.least(e["end"], e["gap_end"]).alias("end"), e["i"].alias("i")))
    return F.filter(parts, lambda x: x["start"] < x["end"])  # of a span and a gap that start together, the gap comes first and tells of nothing


def apart(spans: Column, covers: Column) -> Column:
    """The spans (structs with start and end, in any order) that overlap none of the covers, by end."""
    zero = F.lit(-1).cast("long")
    asked = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("kind"), zero.alias("reach"), s.alias("span")))
    told = lambda kind: F.transform(covers, lambda c: F.struct(c["start"].alias("at"), F.lit(1).alias("kind"), c["end"].alias("reach"), F.lit(None).cast(kind).alias("span")))

    def kept(events: Column) -> Column:
        # a cover that starts before a span's end overlaps it unless it ends by the span's start: the farthest end decides
        reach = scan(F.transform(events, lambda e: e["reach"]), zero, F.greatest)
        both = F.zip_with(events, reach, lambda e, r: F.struct(e["span"].alias("span"), (e["kind"] == 0).alias("asked"), r.alias("reach")))
        return F.transform(F.filter(both, lambda x: x["asked"] & (x["reach"] <= x["span"]["start"])), lambda x: x["span"])

    order = lambda e: F.array_sort(e, lambda a, b: F.when(a["at"] != b["at"], F.when(a["at"] < b["at"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))
    return bind(order(F.concat(asked, told(SPAN))), kept)


#: Keys that a join gives to every task, at most: those that each hold more than this part of all rows.
HOT_KEYS = 10_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with keyed (one row for each key; n is how many rows have it) on key, and without n.

    Keys of more than 1/HOT_KEYS of all rows (total, the sum of n if it isn't given), of which there are fewer than
    HOT_KEYS, are broadcast, so that their rows stay where they are; the others are joined by a shuffle in which no key is large.
    """
    if total is None:
        total = keyed.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) > max(1, total // HOT_KEYS)
    hot, added = keyed.where(is_hot), [c for c in keyed.columns if c not in (key, n)]
    marked = rows.join(F.broadcast(hot.select(key, F.struct(F.lit(1).alias("hot"), *added).alias("own_hot"))), key, "left")
    near = marked.where("own_hot is not null").select(*rows.columns, *[F.col("own_hot")[c].alias(c) for c in added])
    rest = marked.where("own_hot is null").select(*rows.columns).join(keyed.where(~is_hot | F.col(n).isNull()).drop(n), key, how)
    return near.unionByName(rest)


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ","), 256)
