"""More queries: joins by inequality, multiset operations, distributions and value ranges of windows, nested data, formats, functions of one's own, streams."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cents
from ..operators import exact_quantiles
from ..sources import read, table, write
from ..streaming import event_stream, joined_within, run_available, run_complete, session_counts
from .relational import _plain_times, _stream_folder, plan


@plan("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    """No equality to shuffle by: the smaller side is broadcast, here a table of five rows whatever the scale."""
    return table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


@plan("""
SELECT 'both' AS part, k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) GROUP BY k
UNION ALL SELECT 'rest', k, count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k
""")
def set_operations_all(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, part: df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "k", "n")
    return count(c.intersectAll(s), "both").unionByName(count(c.exceptAll(s), "rest"))


@plan("""
SELECT o_orderkey, CAST(ntile(3) OVER w AS BIGINT) AS third, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, first_value(o_orderkey) OVER w AS cheapest,
  last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dearest,
  nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
""")
def window_distribution(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.ntile(3).over(w).cast("long").alias("third"),
        F.round(F.percent_rank().over(w), 6).alias("pr"),
        F.round(F.cume_dist().over(w), 6).alias("cd"),
        F.first("o_orderkey").over(w).alias("cheapest"),
        F.last("o_orderkey").over(whole).alias("dearest"),
        F.nth_value("o_orderkey", 2).over(whole).alias("second"),
    )


@plan("""
SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS BIGINT) AS cents90,
  count(*) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) RANGE BETWEEN 90 PRECEDING AND 90 FOLLOWING) AS near
FROM orders
""")
def window_ranges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")))
    return table(spark, d, "orders").select("o_orderkey", F.sum(cents("o_totalprice")).over(w.rangeBetween(-90, 0)).alias("cents90"), F.count("*").over(w.rangeBetween(-90, 90)).alias("near"))


@plan("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, event_type || '=' || (props ->> '$.k') AS label, CAST(props ->> '$.k' AS BIGINT) + 1 AS more FROM events")
def nested_data(spark: SparkSession, d: str) -> DataFrame:
    """JSON to a struct, a struct with a changed field, and a map by key and value."""
    told = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("s"))
    told = told.select("event_id", "s", F.create_map("event_type", F.col("s.k").cast("string")).alias("m"), F.col("s").withField("k", F.col("s.k") + 1).alias("t"))
    return told.select("event_id", F.col("s.k").alias("k"), F.concat_ws("=", F.map_keys("m")[0], F.map_values("m")[0]).alias("label"), F.col("t.k").alias("more"))


@plan("SELECT kind, count(*) AS n, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS price_cents, count(DISTINCT p_name) AS n_names FROM part, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS f(kind) GROUP BY kind")
def format_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """A table written and read back in each format that keeps columns."""
    parts, base, out = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), _stream_folder(spark, "formats"), None
    for kind in ("csv", "json", "orc", "parquet"):
        write(parts, f"{base}/{kind}", kind)
        back = read(spark, f"{base}/{kind}", kind, schema=parts.schema).select(F.lit(kind).alias("kind"), "p_name", "p_retailprice")
        out = back if out is None else out.unionByName(back)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum(cents("p_retailprice")).alias("price_cents"), F.count_distinct("p_name").alias("n_names"))


def _vowels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in batches:
        yield names.str.count("[aeiou]").astype("int64")


@plan("SELECT p_partkey, CAST(length(regexp_replace(p_name, '[^aeiou]', '', 'g')) AS BIGINT) AS vowels FROM part")
def user_function(spark: SparkSession, d: str) -> DataFrame:
    """A function of one's own over Arrow batches."""
    return table(spark, d, "part").select("p_partkey", F.pandas_udf(_vowels, "long")("p_name").alias("vowels"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pa.Table.from_batches([batch]).append_column("squares", pc.multiply(batch.column("size"), batch.column("size")))
        out = own.group_by("p_brand").aggregate([("size", "sum"), ("squares", "sum"), ("size", "count")])
        yield from out.select(["p_brand", "size_sum", "squares_sum", "size_count"]).rename_columns(["p_brand", "s", "q", "n"]).to_batches()


@plan("SELECT p_brand, count(*) AS n, round(var_pop(CAST(p_size AS DOUBLE)), 6) AS spread FROM part GROUP BY p_brand")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate of one's own: Python sums each Arrow batch, Spark adds the sums up, so no group has to fit a task."""
    sizes = table(spark, d, "part").select("p_brand", F.col("p_size").cast("long").alias("size"))
    sums = sizes.mapInArrow(_partial, "p_brand string, s long, q long, n long").groupBy("p_brand").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    return sums.select("p_brand", "n", F.round((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")), 6).alias("spread"))


class _Words:
    """The words of a text and their places."""

    def eval(self, key: int, text: str):
        for at, word in enumerate((text or "").split(" ")):
            yield key, at, word


@plan("SELECT p_partkey, CAST(i - 1 AS BIGINT) AS place, string_split(p_type, ' ')[i] AS word FROM (SELECT p_partkey, p_type, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part)")
def user_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A table function of one's own, joined laterally."""
    words = F.udtf(_Words, returnType="p_partkey long, place long, word string")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_type")
    return parts.lateralJoin(words(F.col("k").outer(), F.col("p_type").outer())).select("p_partkey", "place", "word")


@plan("SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.99) AS q99, CAST(min(l_extendedprice) AS DOUBLE) AS least FROM lineitem GROUP BY l_returnflag, l_linestatus")
def exact_quantiles_by_two(spark: SparkSession, d: str) -> DataFrame:
    return exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"q25": 0.25, "q99": 0.99, "least": 0.0})


@plan("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    """All sessions, also those still open when the stream has taken in the table."""
    out = _stream_folder(spark, "sessions")
    return _plain_times(run_complete(session_counts(event_stream(spark, d), "1 hour", ["user_id"]), f"{out}/table", f"{out}/checkpoint"))


@plan("""
SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') AS p
JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts > p.ts - INTERVAL 6 HOURS
""")
def streaming_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the views of the six hours before, both from streams."""
    bought = event_stream(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = event_stream(spark, d, time="ts").where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    out = _stream_folder(spark, "joined")
    return run_available(joined_within(bought, seen, "user_id", "ts", "view_ts", "6 HOURS").select("event_id", "user_id", "view_id"), f"{out}/table", f"{out}/checkpoint")
