"""Readers and writers of files, by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
FORMATS = ("parquet", "orc", "csv", "json", "text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; filters and column choices made on it reach the scan."""
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Read files of a format. CSV and JSON need a schema: inferring one would read all of the data an extra time."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind!r}; there are {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.options(header="true", mode="FAILFAST", escape='"', multiLine="true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """Write files of a format; with partition_by, a folder for each value, each written by few tasks."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind!r}; there are {', '.join(FORMATS)}")
    if partition_by:
        df = df.hint("rebalance", *partition_by)  # few files a folder, and large folders are split
    writer = df.write.format(kind).mode(mode)
    if kind == "csv":
        writer = writer.options(header="true", escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**options).save(path)
