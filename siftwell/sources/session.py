"""What a session needs before the library's Python code can run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch of rows that Spark hands to Python at once, so that what a worker holds doesn't follow the rows' width.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; needless where it is installed there. Bounds Arrow batches by bytes, unless the session sets a bound of its own."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="siftwell-"), "siftwell.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.join(os.path.basename(root), os.path.relpath(at, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
