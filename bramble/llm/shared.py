"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of a numpy kernel handles; its temporary arrays take about 60 times this.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one, but only for a master on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="bramble-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_OPEN: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for own in _OPEN[-1:]:
        own.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """All that operators write to the shared folder inside is deleted at the end: for callers that write the result inside, too.

    Operators return lazy results that read these tables, so they can't delete them themselves.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet. The files of its shuffles go with that: else they stay until the driver's JVM happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lost executors don't make it be computed twice."""
    path = fresh_path(df.sparkSession, label)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared folder, through the file system that holds it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut batches so that the texts of each piece have about `limit` bytes; one text is never cut."""
    for batch in batches:
        at, n = 0, batch.num_rows
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        while at < n:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(sizes.searchsorted(before + limit, side="right")))
            piece = batch.slice(at, end - at)
            yield piece, texts.slice(at, end - at).to_pylist()
            at = end
