"""Windows of time, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timestamp(df: DataFrame, time: str) -> Column:
    """The column as a timestamp; left alone if it is one, as a cast would hide a stream's watermark."""
    return F.col(time) if dict(df.dtypes)[time] == "timestamp" else F.col(time).cast("timestamp")


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by window_start, window_end and keys."""
    return sliding(df, time, size, size, keys, *aggregates)


def sliding(df: DataFrame, time: str, size: str, slide: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """As tumbling(), with a window each `slide`; a row is in size / slide windows."""
    out = df.groupBy(F.window(_timestamp(df, time), size, slide), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c != "window"))


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by keys and session: rows of a key less than `gap` apart. session_end is the last row's time and the gap."""
    out = df.groupBy(F.session_window(_timestamp(df, time), gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *(c for c in out.columns if c != "session_window"))
