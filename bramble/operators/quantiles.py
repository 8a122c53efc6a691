"""Exact quantiles of groups of any size, none of which has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which a group's values are cut, from its least to its greatest.
RANGES = 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """A row for each group with values: by name, the interpolated quantile. Nulls are left out.

    Values are counted first, so ties are one row. Counts by range tell which ranges hold the wanted ranks; only their values
    are ranked. A group's values are cut by width, so a range is large only where many different values lie close together.
    """
    counted = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    named = [f"_k{i}" for i in range(len(keys))]
    ends = counted.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_all")).withColumnsRenamed(dict(zip(keys, named, strict=True)))
    same = [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, named, strict=True)]
    placed = counted.join(ends, same).drop(*named)
    width = F.col("_high") / RANGES - F.col("_low") / RANGES
    at = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(RANGES - 1))).otherwise(0).cast("long")
    placed = placed.withColumn("_range", at)
    by_range = placed.groupBy(*keys, "_range", "_all").agg(F.sum("_n").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("_all") - 1) * q).alias("pos")) for name, q in quantiles.items()))
    ranges = by_range.withColumn("_before", upto - F.col("_c")).withColumn("_w", F.explode(wanted))
    holds = (F.floor("_w.pos") < F.col("_before") + F.col("_c")) & (F.ceil("_w.pos") >= F.col("_before"))
    ranges = ranges.where(holds).select(*(F.col(k).alias(x) for k, x in zip(keys, named, strict=True)), F.col("_range").alias("_r"), "_before", F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos"))
    hits = placed.join(ranges, [*same, F.col("_range") == F.col("_r")]).drop(*named, "_r")
    within = Window.partitionBy(*keys, "_name", "_range").orderBy("_v")
    ranked = hits.withColumn("_last", F.col("_before") + F.sum("_n").over(within) - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    of = lambda place: (F.col("_first") <= place) & (F.col("_last") >= place)
    both = ranked.groupBy(*keys, "_name").agg(F.max("_pos").alias("_pos"), F.max(F.when(of(F.floor("_pos")), F.col("_v"))).alias("_a"), F.max(F.when(of(F.ceil("_pos")), F.col("_v"))).alias("_b"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return both.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, between)).alias(name) for name in quantiles))
