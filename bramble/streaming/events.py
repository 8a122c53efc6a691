"""Streams over event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.time_windows import sessions, tumbling


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", watermark: str = "1 hour", time: str = "ts", **options: str) -> DataFrame:
    """New files of a folder as a stream; the time column as a timestamp, with a watermark, for rows that come late."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).options(**options).parquet(folder)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def windowed_counts(stream: DataFrame, size: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Rows by window and keys."""
    return tumbling(stream, time, size, keys, F.count("*").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark; state for older keys is dropped."""
    return stream.dropDuplicatesWithinWatermark(keys)


def session_counts(stream: DataFrame, gap: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Rows by session and keys; a session is given when the watermark has passed its end."""
    return sessions(stream, time, gap, keys, F.count("*").alias("n"))


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, span: str) -> DataFrame:
    """Rows of two streams with one key of which the right one came at most `span` before the left one; watermarks bound the state of both."""
    near = (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) > F.col(left_time) - F.expr(f"INTERVAL {span}"))
    return left.join(right.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & near).drop("_key")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Take in all that is there now, write it to Parquet once, and return the table. A stopped run goes on from its checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """As run_available(), for aggregates: with the groups that are still open, and late rows. The table is written anew by each run that finds something."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
