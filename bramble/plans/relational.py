"""Queries over the star schema and the events, by name, each with DuckDB SQL.

Sums are taken over decimals or whole cents, so they don't depend on the order of rows. Every plan reads whole tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cents, json_number, money, norm
from ..operators import as_of_join, exact_quantiles, grouping_sets, range_join, salted_count_distinct, sessions, sliding, top_per_group, tumbling
from ..sources import table
from ..streaming import deduplicated, event_stream, run_available, run_complete, windowed_counts

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, tuple[Plan, str | None]] = {}


def plan(sql: str | None) -> Callable[[Plan], Plan]:
    def keep(f: Plan) -> Plan:
        PLANS[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Plan]:
    return {name: f for name, (f, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}


REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))"


def _revenue():
    return money("l_extendedprice") * (1 - money("l_discount"))


@plan(f"""
SELECT r_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
""")
def region_revenue(spark: SparkSession, d: str) -> DataFrame:
    # The large tables join and aggregate on a number; the names come in last.
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    by_nation = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(_revenue()).alias("r"), F.count("*").alias("n"))
    named = by_nation.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name").agg(F.sum("r").cast("double").alias("revenue"), F.sum("n").alias("n_lines"))


@plan(f"""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum({REVENUE}) AS DOUBLE) AS sum_revenue,
  CAST(sum({REVENUE} * (1 + CAST(l_tax AS DECIMAL(12,2)))) AS DOUBLE) AS sum_charge, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(_revenue()).cast("double").alias("sum_revenue"),
        F.sum(_revenue() * (1 + money("l_tax"))).cast("double").alias("sum_charge"),
        F.count("*").alias("n"),
    )


@plan("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@plan("""
SELECT c_custkey, count(o_orderkey) AS n_orders, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(12,2))), 0) AS DOUBLE) AS spent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def outer_join_counts(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("s"))
    out = table(spark, d, "customer").select("c_custkey").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("spent"))


@plan("SELECT o_orderkey, o_orderdate FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_returnflag = 'R')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'")
    return table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderdate")


@plan("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


@plan("""
SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers
FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) AS c
FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) AS s ON c_nationkey = s_nationkey
""")
def full_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    out = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    return out.select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), F.coalesce("c", F.lit(0)).cast("long").alias("n_customers"), F.coalesce("s", F.lit(0)).cast("long").alias("n_suppliers"))


@plan("""
SELECT p_partkey, e.event_id FROM part JOIN events AS e ON e.value >= p_retailprice / 20 AND e.value < p_retailprice / 20 + 0.05
""")
def range_join_bands(spark: SparkSession, d: str) -> DataFrame:
    bands = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 20).alias("low"), (F.col("p_retailprice") / 20 + 0.05).alias("high"))
    return range_join(table(spark, d, "events").select("event_id", "value"), bands, "value", "low", "high", width=0.1).select("p_partkey", "event_id")


@plan("""
SELECT p.event_id, p.user_id, v.ts AS view_ts, v.event_id AS view_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') AS p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def as_of_last_view(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return as_of_join(bought, seen, ["user_id"], "ts", "view_ts", ["view_id"]).select("event_id", "user_id", "view_ts", "view_id")


@plan("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets_flags(spark: SparkSession, d: str) -> DataFrame:
    return grouping_sets(table(spark, d, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], F.count("*").alias("n"), F.sum(money("l_quantity")).cast("double").alias("qty"))


@plan("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS all_status, CAST(grouping(o_orderpriority) AS BIGINT) AS all_priority FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, d: str) -> DataFrame:
    cube = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority")
    return cube.agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("all_status"), F.grouping("o_orderpriority").cast("long").alias("all_priority"))


@plan("SELECT p_brand, p_type, count(*) AS n, CAST(max(p_size) AS BIGINT) AS max_size FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").cast("long").alias("max_size"))


@plan("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY l_suppkey")
def distinct_parts(spark: SparkSession, d: str) -> DataFrame:
    return salted_count_distinct(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", salts=8)


@plan("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median_price, quantile_cont(l_extendedprice, 0.9) AS p90_price FROM lineitem GROUP BY l_returnflag")
def exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median_price": 0.5, "p90_price": 0.9})


@plan("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_orderpriority
""")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c.lower()}") for c in "FOP"))


@plan("""
SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part
""")
def unpivot_parts(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "measure", "value")


@plan("""
SELECT o_orderkey, o_custkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)
""")
def window_ranks(spark: SparkSession, d: str) -> DataFrame:
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    numbered = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.rank().over(by_price).cast("long").alias("r"),
        F.dense_rank().over(by_price).cast("long").alias("dr"),
        F.row_number().over(numbered).cast("long").alias("rn"),
        F.lag("o_totalprice").over(by_date).alias("before"),
        F.lead("o_totalprice").over(by_date).alias("after"),
    )


@plan("""
SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS cents3,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cents_so_far
FROM orders
""")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.sum(cents("o_totalprice")).over(w.rowsBetween(-2, 0)).alias("cents3"), F.sum(cents("o_totalprice")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cents_so_far"))


@plan("""
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM orders) WHERE rank <= 3
""")
def top_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    top = top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.withColumn("rank", F.col("rank").cast("long"))


@plan("""
(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").cast("long")))
    rest = table(spark, d, "orders").select("o_custkey").subtract(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    return both.union(rest)


@plan("""
SELECT p_partkey, upper(p_brand) AS brand, CAST(length(p_name) AS BIGINT) AS n, substring(p_name, 1, 4) AS head, p_name || '/' || p_type AS label, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n_words,
  md5(p_name) AS digest, CAST(p_size % 7 AS BIGINT) AS m, round(sqrt(p_retailprice), 6) AS root, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class
FROM part
""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey",
        F.upper("p_brand").alias("brand"),
        F.length("p_name").cast("long").alias("n"),
        F.substring("p_name", 1, 4).alias("head"),
        F.concat("p_name", F.lit("/"), "p_type").alias("label"),
        F.size(F.split("p_type", " ")).cast("long").alias("n_words"),
        F.md5("p_name").alias("digest"),
        (F.col("p_size") % 7).cast("long").alias("m"),
        F.round(F.sqrt("p_retailprice"), 6).alias("root"),
        F.when(F.col("p_size") > 25, "big").otherwise("small").alias("class"),
    )


@plan("""
SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS dow, count(*) AS n, CAST(max(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) AS BIGINT) AS last_day
FROM orders GROUP BY ALL
""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    grouped = table(spark, d, "orders").groupBy(F.year(day).cast("long").alias("y"), F.month(day).cast("long").alias("m"), F.dayofweek(day).cast("long").alias("dow"))
    return grouped.agg(F.count("*").alias("n"), F.max(F.datediff(day, F.lit("1995-01-01").cast("date"))).cast("long").alias("last_day"))


@plan("SELECT event_type, count(*) AS n, sum(CAST(props ->> '$.k' AS DOUBLE)) AS sum_k, count(*) FILTER (CAST(props ->> '$.k' AS DOUBLE) > 50) AS n_large FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = json_number("props", "$.k")  # whole numbers: their sum is exact
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.count_if(k > 50).alias("n_large"))


@plan("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, CAST(list_max(embedding) AS DOUBLE) AS largest FROM embeddings")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(norm("embedding"), 4).alias("norm"), F.array_max("embedding").cast("double").alias("largest"))


@plan("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    return _plain_times(tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], F.count("*").alias("n")))


@plan("""
SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - o * INTERVAL 1 HOUR AS s FROM events, range(2) AS r(o)) GROUP BY s
""")
def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    return _plain_times(sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", [], F.count("*").alias("n")))


@plan("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    return _plain_times(sessions(table(spark, d, "events"), "ts", "1 hour", ["user_id"], F.count("*").alias("n")))


def _plain_times(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes))


@plan(PLANS["tumbling_events"][1])
def streaming_hourly(spark: SparkSession, d: str) -> DataFrame:
    """All windows, also those still open when the stream has taken in the table."""
    out = _stream_folder(spark, "hourly")
    stream = windowed_counts(event_stream(spark, d), "1 hour", ["event_type"])
    return _plain_times(run_complete(stream, f"{out}/table", f"{out}/checkpoint"))


@plan("SELECT event_id, user_id, event_type FROM events")
def streaming_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """A stream that brings each event three times, brought down to one."""
    out = _stream_folder(spark, "first")
    once = event_stream(spark, d)
    stream = deduplicated(once.unionByName(once).unionByName(once), ["event_id"]).select("event_id", "user_id", "event_type")
    return run_available(stream, f"{out}/table", f"{out}/checkpoint")


def _stream_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share; where none is named, a local one, but only for a master on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="bramble-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
