"""Incremental calibration over a stream of predictions: an addition of this library, as batches are all it starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.calibration import histogram


def update_histogram(predictions: DataFrame, path: str, checkpoint: str, buckets: int = 10):
    """Starts a query that writes one histogram for each micro-batch, under the batch's number, so that a batch that is run again replaces its own; the sum over all of them is the histogram."""

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        part = histogram(batch, buckets).withColumn("batch", F.lit(number))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
