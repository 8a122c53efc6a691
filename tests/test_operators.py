"""Operators on small inline tables, with nulls, ties and empty inputs."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bramble import functions, operators

DAY = datetime(2024, 1, 1)
EVENT = "k string, t timestamp, v long"
TOLD = "k string, rt timestamp, w long"


def at(minutes):
    return None if minutes is None else DAY + timedelta(minutes=minutes)


def as_of(left, right):
    out = []
    for k, t, v in left:
        fits = [(rt, w) for rk, rt, w in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        best = max(fits, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=(None, None))
        out.append((k, t, v, *best))
    return sorted(out, key=str)


def run_as_of(spark, left, right, bucket):
    out = operators.as_of_join(spark.createDataFrame(left, EVENT), spark.createDataFrame(right, TOLD), ["k"], "t", "rt", ["w"], bucket)
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("bucket", [60, 86_400])
def test_as_of_join(spark, bucket):
    left = [("a", at(0), 1), ("a", at(10), 2), ("a", at(5000), 3), ("b", at(3), 4), (None, at(3), 5), ("a", None, 6), ("a", at(10), 2)]
    right = [("a", at(10), 7), ("a", at(10), 9), ("a", at(12), 1), ("c", at(0), 1), (None, at(0), 1), ("a", None, 3), ("b", at(4), 2)]
    assert run_as_of(spark, left, right, bucket) == as_of(left, right)
    assert run_as_of(spark, left, [], bucket) == as_of(left, [])
    assert run_as_of(spark, [], right, bucket) == []


times = st.one_of(st.none(), st.integers(0, 400))
rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), times, st.integers(0, 3)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=rows, right=rows)
def test_as_of_join_any(spark, left, right):
    left, right = [(k, at(t), v) for k, t, v in left], [(k, at(t), v) for k, t, v in right]
    assert run_as_of(spark, left, right, 3600) == as_of(left, right)


def test_as_of_join_names(spark):
    df = spark.createDataFrame([("a", DAY, 1)], EVENT)
    with pytest.raises(ValueError):
        operators.as_of_join(df, df, ["k"], "t", "t", ["v"])


def test_range_join(spark):
    points = [(1, 0.5), (2, 1.0), (3, 2.0), (4, -0.5), (5, None), (6, 1.0)]
    ranges = [("x", 0.0, 1.0), ("y", 1.0, 2.0), ("z", -1.0, 9.0), ("w", 1.0, 1.0), ("n", None, 1.0), ("y", 1.0, 2.0)]
    out = operators.range_join(spark.createDataFrame(points, "id long, p double"), spark.createDataFrame(ranges, "name string, low double, high double"), "p", "low", "high", 0.7)
    want = sorted((i, n) for i, p in points for n, a, b in ranges if None not in (p, a, b) and a <= p < b)
    assert sorted((r["id"], r["name"]) for r in out.collect()) == want


def test_top_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 5), ("b", None)], "k string, v long")
    out = operators.top_per_group(df, ["k"], [F.desc_nulls_last("v")], 2)
    assert sorted(((r["k"], r["v"], r["rank"]) for r in out.collect()), key=str) == sorted([("a", 3, 1), ("a", 2, 2), (None, 5, 1), ("b", None, 1)], key=str)


def test_salted_count_distinct(spark):
    df = spark.createDataFrame([("a", i % 7) for i in range(100)] + [("a", None), ("b", None), (None, 1)], "k string, v long")
    out = {r["k"]: r["n_distinct"] for r in operators.salted_count_distinct(df, ["k"], "v", salts=3).collect()}
    assert out == {"a": 7, "b": 0, None: 1}


def test_grouping_sets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    out = operators.grouping_sets(df, [["p", "q"], ["q"], []], F.count("*").alias("n"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), (None, "x", 2), (None, "y", 1), (None, None, 3)], key=str)


def test_time_windows(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(59)), ("a", at(60)), ("a", at(200)), ("b", None)], "k string, t timestamp")
    hours = operators.tumbling(df, "t", "1 hour", [], F.count("*").alias("n")).orderBy("window_start").collect()
    assert [r["n"] for r in hours] == [2, 1, 1]
    assert sum(r["n"] for r in operators.sliding(df, "t", "2 hours", "1 hour", [], F.count("*").alias("n")).collect()) == 8
    found = operators.sessions(df, "t", "1 hour", ["k"], F.count("*").alias("n")).orderBy("session_start").collect()
    assert [(r["k"], r["n"], r["session_end"]) for r in found] == [("a", 3, at(120)), ("a", 1, at(260))]


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], '{"k": 2.5}', 1.005), ([0.0], [1.0], "no json", None), (None, [1.0], None, -2.5)], "a array<float>, b array<float>, j string, m double")
    out = df.select(functions.norm("a"), functions.cosine("a", "b"), functions.json_number("j", "$.k"), functions.cents("m")).collect()
    assert tuple(out[0])[:3] == (5.0, pytest.approx(0.96), 2.5) and tuple(out[1]) == (0.0, None, None, None) and tuple(out[2]) == (None, None, None, -250)


def test_exact_quantiles(spark):
    """Ties, one value, nulls, a null group, values far apart, and no rows."""
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=400).round(1).tolist() + [1e12, -1e12], "b": [5.0] * 50, "c": [1.0], None: [float(x) for x in range(11)], "d": [0.1, 0.2]}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"q0": 0.0, "q33": 0.33, "q50": 0.5, "q999": 0.999, "q1": 1.0}
    out = {r["k"]: r for r in operators.exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(out) == set(groups)
    for k, own in groups.items():
        for name, q in wanted.items():
            assert abs(out[k][name] - np.quantile(own, q)) <= 1e-9 * max(1, abs(np.quantile(own, q))), (k, name)
    assert operators.exact_quantiles(df.limit(0), ["k"], "v", wanted).count() == 0
