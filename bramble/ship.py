"""The package on the executors: Python workers import it where their functions are defined by name."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch on its way to or from Python: a worker holds two or so, beside what its kernel needs.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the session's executors, once for each Spark context; harmless where it is installed.

    Arrow batches of the session are bounded too, for long texts would else make batches of any size.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(context, "_bramble_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="bramble-ship-"), "bramble.zip")  # Spark's file server reads it from the driver
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("bramble", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._bramble_shipped = True
