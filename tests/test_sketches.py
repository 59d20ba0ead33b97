"""Incremental profiles: stored per day, merged, against exact statistics."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import monitoring, sketches


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF001}/lineitem.parquet").select(
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day"), "l_returnflag", "l_partkey",
        F.nullif("l_quantity", F.lit(7)).alias("l_quantity"),
        F.concat(F.lit("mode "), F.least(F.col("l_suppkey") % 9, F.lit(4)).cast("string"))
        .alias("mode"), "l_shipdate")


COLUMNS = ["l_partkey", "l_quantity", "mode", "l_shipdate"]


def check(rows, pdf):
    for r in rows:
        x = pdf[r.column_name]
        assert r.row_count == len(x) and r.null_count == x.isna().sum()
        assert abs(r.unique_count - x.nunique()) <= max(1, 4 * sketches.DISTINCT_ERROR * x.nunique())
        if r.mean is None:
            continue
        v = x.dropna().astype(float)
        assert math.isclose(r.mean, v.mean(), rel_tol=1e-9)
        assert len(v) < 2 or math.isclose(r.std, v.std(), rel_tol=1e-9)
        assert (r.min, r.max) == (v.min(), v.max())
        for q, got in ((.25, r.q25), (.5, r.median), (.75, r.q75)):
            low, high = (v < got).mean(), (v <= got).mean()
            assert low - sketches.RANK_ERROR - 1 / len(v) <= q \
                <= high + sketches.RANK_ERROR + 1 / len(v)


def test_merged_days_against_exact_statistics(spark, lines, tmp_path):
    path = f"{tmp_path}/p"
    sketches.store(lines, path, "day", COLUMNS, ["l_returnflag"])
    days = [r.day for r in lines.select("day").distinct().orderBy("day").collect()]
    half = days[len(days) // 2]
    # a day that is stored again replaces itself
    sketches.store(lines.where(F.col("day") >= F.lit(half)), path, "day", COLUMNS, ["l_returnflag"])
    stored = sketches.load(spark, path, "day")
    pdf = lines.toPandas()
    whole = sketches.finish(sketches.merge(stored)).collect()
    assert {r.column_name for r in whole} == set(COLUMNS)
    check(whole, pdf)
    by = {r.column_name: r for r in whole}
    counts = pdf["mode"].value_counts()
    assert {t.item: t["count"] for t in by["mode"].top_values} == dict(counts)
    assert (by["mode"].min_length, by["mode"].avg_length) == (6, 6.0)
    assert by["l_shipdate"].date_range_days == (pdf.l_shipdate.max() - pdf.l_shipdate.min()).days
    flags = sketches.finish(sketches.merge(stored, ["l_returnflag"])).collect()
    for flag in set(pdf.l_returnflag):
        check([r for r in flags if r.l_returnflag == flag], pdf[pdf.l_returnflag == flag])
    late = sketches.finish(sketches.merge(sketches.load(spark, path, "day", start=half))).collect()
    check(late, pdf[pdf.day >= half])
    # merged rows merge again
    twice = sketches.finish(sketches.merge(sketches.merge(stored, ["l_returnflag"]))).collect()
    check(twice, pdf)


def test_days_outside_are_not_read(spark, lines, tmp_path):
    sketches.store(lines, f"{tmp_path}/p", "day", ["l_partkey"])
    plan = sketches.load(spark, f"{tmp_path}/p", "day", start="1997-01-01") \
        ._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_nulls_empty_and_group_of_null(spark):
    rows = [(None, None, None), (None, 2.0, None), ("g", None, None), ("g", float("nan"), "x")]
    df = spark.createDataFrame(rows, "g string, v double, t string")
    got = {(r.g, r.column_name): r for r in
           sketches.finish(sketches.merge(sketches.sketch(df, ["v", "t"], ["g"]), ["g"])).collect()}
    assert len(got) == 4
    assert got[None, "v"].mean == 2.0 and got[None, "v"].median == 2.0
    assert got["g", "v"].mean is None and got["g", "v"].median is None
    assert got[None, "t"].unique_count == 0 and got[None, "t"].top_values == []
    assert got["g", "t"].unique_count == 1 and got["g", "t"].null_count == 1
    assert sketches.finish(sketches.merge(sketches.sketch(df.limit(0)))).collect() == []


def test_stored_profiles_feed_anomalies(spark):
    rows = [(d, 1.0 + (d % 3) + (50 if d == 20 else 0)) for d in range(1, 25) for _ in range(3)]
    df = spark.createDataFrame(rows, "d int, v double") \
        .select(F.make_date(F.lit(2024), F.lit(1), F.col("d")).alias("day"), "v")
    series = sketches.metric_series(sketches.sketch(df, ["v"], ["day"]), [], "day")
    found = monitoring.anomalies(series, "key", "day", "value").where("is_anomaly").collect()
    assert {(r.metric, r.day.day) for r in found} == {("mean", 20)}
