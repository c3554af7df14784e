"""Sinks. Spark's commit protocol makes each of them whole or absent; parts of partitioned tables are replaced one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """Header and rows; the named columns with so many digits, nulls as empty."""
    shown = {c: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{n}f", F.col(c).cast("double"))) for c, n in (digits or {}).items()}
    df.withColumns(shown).write.mode("overwrite").csv(path, header=True)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def round_part(df: DataFrame, path: str) -> None:
    """Results with a column round: each round is a partition, replaced when it is run again; a summary reads them all."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def embedding_cache(df: DataFrame, path: str) -> None:
    df.select("name", "emb", "ok").write.mode("append").parquet(path)


def files(df: DataFrame, folder: str) -> DataFrame:
    """Writes content under folder/file for every row (file, content) and gives status rows (file, status).

    The folder must be one that all executors see. Existing files stay; names that would leave the folder are errors.
    """
    import pyarrow as pa

    def run(batches):
        import os
        import uuid

        for batch in batches:
            status = []
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    path = os.path.normpath(os.path.join(folder, name))
                    if os.path.commonpath([path, os.path.normpath(folder)]) != os.path.normpath(folder):
                        raise ValueError("outside the folder")
                    if os.path.exists(path):
                        status.append("kept")
                        continue
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(tmp := f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
                        f.write(content)
                    os.replace(tmp, path)
                    status.append("written")
                except Exception as e:  # a failure is a row
                    status.append(f"error: {e}")
            yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "status": pa.array(status, pa.string())})

    return df.select("file", "content").mapInArrow(run, "file string, status string")


def parts(df: DataFrame, path: str, by: str) -> None:
    """Rows by a column, each value's rows a partition that is replaced when it is written again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def unscanned(shards: DataFrame, path: str) -> DataFrame:
    """The shards (shard) that a scan table under path doesn't have yet."""
    spark = shards.sparkSession
    return shards.join(spark.read.parquet(path).select("shard").distinct(), "shard", "left_anti") if _exists(spark, path) else shards


def scan(shards: DataFrame, path: str, read) -> DataFrame:
    """Scans the shards that are left and gives the whole table. read takes shards to rows with a column shard.

    A shard's rows are committed together, so that a failed run leaves whole shards and the next one goes on from there.
    """
    spark = shards.sparkSession
    left = unscanned(shards, path)
    if not left.isEmpty():
        parts(read(left), path, "shard")
    return spark.read.parquet(path)


def manifests(samples: DataFrame, buckets: DataFrame, path: str) -> None:
    """The manifest of samples and all buckets, with whether they were kept, side by side."""
    csv(samples, f"{path}/manifest")
    csv(buckets.select("rank", "width", "height", "count", F.col("kept").cast("int").alias("kept")), f"{path}/buckets")


def with_summary(rows: DataFrame, summary: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """Rows as CSV and one line of JSON that sums them up."""
    csv(rows, f"{path}/rows", digits)
    json_rows(summary.coalesce(1), f"{path}/summary")


def exported(images: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """Writes the content of images under the names that etl.export_names gives them (global_row, file); gives file and status."""
    return files(names.select("global_row", "file").join(images.select("global_row", "content"), "global_row"), folder)


def copied(rows: DataFrame, folder: str, header) -> DataFrame:
    """Writes the content of rows (file, content, width, height) whose header says their size; gives file and status.

    header gives (width, height) of a content; another size or a failure is a status, and that file isn't written.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            status = []
            for content, width, height in zip(*(batch.column(c).to_pylist() for c in ("content", "width", "height")), strict=True):
                try:
                    found = tuple(header(content))[:2]
                    status.append(None if found == (width, height) else f"error: is {found[0]}x{found[1]}")
                except Exception as e:
                    status.append(f"error: {e}")
            yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "content": batch.column("content"), "status": pa.array(status, pa.string())})

    checked = rows.select("file", "content", "width", "height").mapInArrow(run, "file string, content binary, status string")
    return files(checked.where("status is null"), folder).unionByName(checked.where("status is not null").select("file", "status"))


def captions(records: DataFrame, path: str) -> None:
    """Records as JSON lines; a record's errors stay in it."""
    records.write.mode("overwrite").json(path)


def attention(rows: DataFrame, path: str) -> None:
    """Raw attention as arrays."""
    rows.write.mode("overwrite").parquet(path)
