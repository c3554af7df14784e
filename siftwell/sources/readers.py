"""Sources: image folders, scan tables, captions, shards, Arrow streams. Schemas are always given, never inferred."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import base_name, is_augmented, seeded_order, stem, suffix
from ..operators.sampling import even_rows, numbered

TRAINING = ("png", "jpg", "jpeg", "webp")
PROFILED = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff")
SCAN = "split string, shard string, row_group int, row int, stem string, ext string, width int, height int, format string, nbytes bigint, pooled int, error string"
BUCKETS = "rank int, width int, height int, count int, kept int"
CAPTION = (
    "image_id string, source_image string, width int, height int, status string, error string, prompt string, analysis string, truncated boolean, n_words int, raw_output string, attempts int, "
    "seconds double, model string, created_at string, generation_params struct<max_tokens:int,temperature:double,top_p:double>, _corrupt_record string"
)


def image_dir(spark: SparkSession, path: str, extensions=TRAINING, missing_ok: bool = False) -> DataFrame:
    """path, name, stem, ext, bytes, content of the images right in a folder. Content is read only where it is used."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if not there and not missing_ok:
        raise FileNotFoundError(path)
    if not there:
        return spark.createDataFrame([], "path string, name string, stem string, ext string, bytes bigint, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    p = F.col("path")
    return files.select("path", base_name(p).alias("name"), stem(p).alias("stem"), F.lower(suffix(p)).alias("ext"), F.col("length").alias("bytes"), "content").where(F.col("ext").isin(*[f".{e}" for e in extensions]))


def labelled_pair(real: DataFrame, fake: DataFrame) -> DataFrame:
    """path, label and ord: real rows (0) come before generated ones (1), each by path."""
    both = real.select("path", F.lit(0).alias("label")).unionByName(fake.select("path", F.lit(1).alias("label")))
    if both.isEmpty():
        raise ValueError("no images")
    return both.withColumn("ord", F.struct("label", "path"))


def split_dataset(spark: SparkSession, config: dict, split: str) -> DataFrame:
    return labelled_pair(image_dir(spark, config[f"real_img_{split}_ds_path"]), image_dir(spark, config[f"aigen_img_{split}_ds_path"]))


def not_augmented(files: DataFrame) -> DataFrame:
    return files.where(~is_augmented(F.col("stem")))


def eligible(headers: DataFrame, least: int = 32) -> DataFrame:
    """Readable images larger than least on both sides whose name doesn't say tampered."""
    return headers.where(F.col("error").isNull() & ~F.contains(F.lower("name"), F.lit("tampered")) & (F.least("width", "height") > least))


def sampled(files: DataFrame, sample: int) -> DataFrame:
    """Evenly spaced files in the order of their paths; all of them if there are no more. None at all is an error."""
    found = even_rows(files, "path", sample)
    if found.isEmpty():
        raise ValueError("no images")
    return found


def scan_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Scan tables whose header must be the expected one; rows with an error are kept apart by the caller."""
    return spark.read.schema(SCAN).csv(paths, header=True, enforceSchema=False, mode="FAILFAST")


def buckets_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUCKETS).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """One record for each file; unreadable ones have only _corrupt_record."""
    return spark.read.schema(CAPTION).json(path, multiLine=True, mode="PERMISSIVE")


def parquet_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """content and path of encoded images in shards; other columns aren't read."""
    return spark.read.parquet(*paths).select(F.col("image.bytes").alias("content"), F.col("image.path").alias("path"))


def shards_of(names: list[str], splits: list[str], most: int | None = None) -> list[str]:
    """Names such as train-00001.parquet of the given splits; of more than most, evenly spaced ones."""
    found = sorted(n for n in names if n.rpartition("/")[2].partition("-")[0] in splits)
    return found if not most or len(found) <= most else [found[i * len(found) // most] for i in range(most)]


def arrow_shards(names: list[str]) -> dict[str, list[str]]:
    """Names such as set-train-00000-of-00002.arrow by split, in order."""
    out: dict[str, list[tuple[int, str]]] = {}
    for n in names:
        if m := re.search(r"-([A-Za-z0-9_]+)-(\d+)-of-(\d+)\.arrow$", n):
            out.setdefault(m[1], []).append((int(m[2]), n))
    return {k: [n for _, n in sorted(v)] for k, v in sorted(out.items())}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArrowReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns, self.paths = schema.fieldNames(), options["paths"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator:
        import pyarrow as pa

        with pa.memory_map(partition.path) as f:
            try:
                for batch in pa.ipc.open_stream(f):
                    yield batch.select(self.columns)
            except pa.ArrowInvalid:
                file = pa.ipc.open_file(f)
                for i in range(file.num_record_batches):
                    yield file.get_batch(i).select(self.columns)


class ArrowShards(DataSource):
    """Arrow IPC streams and files, one task each: spark.read.format("arrow_shards").schema(...).option("paths", "a,b").load(). The schema picks the columns."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def schema(self):
        raise ValueError("give the schema with .schema(...)")

    def reader(self, schema) -> DataSourceReader:
        return _ArrowReader(schema, self.options)


def arrow_table(spark: SparkSession, paths: list[str], schema: str, limit: int = 0) -> DataFrame:
    """Rows of Arrow shards; with a limit that many at most, for a look."""
    spark.dataSource.register(ArrowShards)
    rows = spark.read.format("arrow_shards").schema(schema).option("paths", ",".join(paths)).load()
    return rows.limit(limit) if limit else rows


def scan_tables(spark: SparkSession, folder: str, shards: list[str]) -> tuple[DataFrame, dict]:
    """Rows without an error of the scan tables <shard>.csv under a folder, and what was left out: missing shards and rows with an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s for s in shards if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{s}.csv"))]
    rows = scan_csv(spark, [f"{folder}/{s}.csv" for s in there]) if there else spark.createDataFrame([], SCAN)
    wrong = F.coalesce(F.trim("error"), F.lit("")) != ""
    return rows.where(~wrong), {"missing": sorted(set(shards) - set(there)), "errors": rows.where(wrong).count()}


def batches_of(files: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """files with batch (0 and on) and place in it: in the order of their paths, or shuffled by a seed. The last batch may be smaller.

    Files are numbered by ranges of what orders them, so that no task sorts all of them.
    """
    by = F.col("path") if seed is None else seeded_order(seed, F.col("path"))
    start = F.regexp_extract("path", r"\A(.*/)?.{0,3}", 0) if seed is None else F.substring(by, 1, 3)
    rows = numbered(files.withColumns({"__start": start, "__by": by}), "__start", "__by")
    return rows.withColumns({"batch": F.floor(F.col("global_row") / size), "place": (F.col("global_row") % size).cast("int")}).drop("__start", "__by", "global_row")


def train_and_val(spark: SparkSession, config: dict, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Batches of the training split, shuffled, and of the validation split in order."""
    return batches_of(split_dataset(spark, config, "train"), size, seed), batches_of(split_dataset(spark, config, "val"), size)
