"""Aggregates over several groupings, and distinct counts that a hot group doesn't pin to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """One aggregation for each set of columns, in one pass over df; columns that a set hasn't are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(*aggregates)


def salted_count_distinct(df: DataFrame, keys: list[str], value: str, name: str = "n_distinct", salts: int = 64) -> DataFrame:
    """Exact distinct non-null values of each group: deduplicated by group and salt first, so no task gets all of a group."""
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).alias("_salt")
    parts = df.select(*keys, F.col(value).alias("_value"), salt).groupBy(*keys, "_salt").agg(F.count_distinct("_value").alias("_n"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias(name))
