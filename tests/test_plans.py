"""All plans that have SQL against DuckDB; sources, sinks and streams."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from bramble import plans, sources, streaming


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return f"{value:.6f}"
    return str(value)


@pytest.fixture(scope="session")
def duck(sf_small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in sources.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf_small, duck, name):
    df = plans.queries()[name](spark, sf_small)
    own = sorted([[plain(r[c]) for c in sorted(df.columns)] for r in df.collect()], key=str)
    want = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert own == sorted([[plain(r[i]) for i in order] for r in want.fetchall()], key=str)


def test_entry(spark, sf_small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_windows_are_complete(spark, sf_small):
    whole = sorted(map(tuple, plans.queries()["tumbling_events"](spark, sf_small).collect()))
    assert sorted(map(tuple, plans.queries()["streaming_hourly"](spark, sf_small).collect())) == whole


def test_late_rows_and_restart(spark, tmp_path):
    data, out = tmp_path / "in", str(tmp_path / "out")

    def put(n, rows):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        data.mkdir(exist_ok=True)
        part = next(p for p in (tmp_path / f"w{n}").iterdir() if p.name.startswith("part"))
        shutil.copy(part, data / f"events-{n}.parquet")
        os.utime(data / f"events-{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))

    from datetime import datetime

    hour = lambda h, m=0: datetime(2024, 1, 1, h, m)
    run = lambda: streaming.run_available(streaming.windowed_counts(streaming.event_stream(spark, str(data), maxFilesPerTrigger="1"), "1 hour", []), f"{out}/table", f"{out}/checkpoint")
    put(0, [(1, hour(0), "a"), (2, hour(0, 30), "a")])
    put(1, [(3, hour(5), "a")])
    run()
    put(2, [(4, hour(0, 40), "a"), (5, hour(9), "a")])  # the first is later than the watermark allows
    found = sorted((r["window_start"].hour, r["n"]) for r in run().collect())
    assert found[0] == (0, 2) and (5, 1) in found and len(found) == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nthen go', 1.5), (2, None, None)], "a long, b string, c double")
    for kind in ("parquet", "orc", "csv", "json"):
        sources.write(df, f"{tmp_path}/{kind}", kind)
        back = sources.read(spark, f"{tmp_path}/{kind}", kind, schema=df.schema)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str), kind
    sources.write(df, f"{tmp_path}/by", partition_by=("a",))
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.name.startswith("a=")) == ["a=1", "a=2"]
    with pytest.raises(ValueError):
        sources.read(spark, f"{tmp_path}/csv", "csv")
    with pytest.raises(ValueError):
        sources.read(spark, f"{tmp_path}/csv", "avro")
    with pytest.raises(ValueError):
        sources.table(spark, str(tmp_path), "nothing")


def test_scans_are_pruned(spark, sf_small):
    plan = plans.queries()["pricing_summary"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_partkey" not in plan
    plan = sources.table(spark, sf_small, "orders").select("o_orderkey").where(F.col("o_orderstatus") == "F")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
