"""Tree top-k, the robust outlier rule and duplicate rows, against plain Python."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import profile, remediate
from quarry.operators.quality import Rule, run_rules
from quarry.operators.topk import tree_top


def test_tree_top_against_sorting(spark):
    r = random.Random(4)
    rows = [(r.choice("aaaab") if i else None, r.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(23)
    order = [F.col("v").desc(), F.col("i")]
    for k in (1, 4, 1500):
        got = {(x.g, x.rank): (x.v, x.i) for x in tree_top(df, ["g"], order, k, "rank").collect()}
        want = {}
        for g in ("a", "b", None):
            own = sorted((-v, i) for h, v, i in rows if h == g)
            want |= {(g, n + 1): (-v, i) for n, (v, i) in enumerate(own[:k])}
        assert got == want
    assert tree_top(df.limit(0), ["g"], order, 3, "rank").collect() == []


def test_tasks_keep_their_own_first_rows(spark):
    df = spark.range(1000, numPartitions=16).withColumn("g", F.lit(1))
    plan = tree_top(df, ["g"], [F.col("id")], 5, "rank")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_quartiles_find_what_deviations_miss(spark):
    values = [float(i % 10) for i in range(200)] + [1000.0] * 8 + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rules = [Rule("iqr", "accuracy", "v", {"method": "iqr"}),
             Rule("wide", "accuracy", "v", {"method": "iqr", "k": 1000}),
             Rule("z", "accuracy", "v", {"method": "statistical", "z": 6})]
    clean = df.where("NOT isnan(v) OR v IS NULL")
    got = {r.rule_id: r.failed_records for r in run_rules(clean, rules).collect()}
    x = pd.Series([v for v in values if v is not None and v == v])
    q1, q3 = x.quantile(.25), x.quantile(.75)
    assert got["iqr"] == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum() == 8
    assert got["wide"] == got["z"] == 0
    found = {r.rule_id: r.failed_records for r in run_rules(df, rules[:1]).collect()}
    assert found["iqr"] == 9  # not a number is not within bounds
    empty = run_rules(df.where("v IS NULL"), rules[:1]).collect()
    assert (empty[0].failed_records, empty[0].total_records) == (0, 1)


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (None, 2, "c"), (None, 2, "d"),
                                (3, 3, "e")], "k int, l int, n0 string")
    got = {(r.k, r.l, r.n0, r.n) for r in remediate.duplicate_rows(df, ["k", "l"]).collect()}
    assert got == {(1, None, "a", 2), (1, None, "b", 2), (None, 2, "c", 2), (None, 2, "d", 2)}
    assert remediate.duplicate_rows(df.limit(0), ["k"]).collect() == []


def test_profile_of_many_columns_counts_distinct_in_passes(spark):
    df = spark.range(40).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(9)])
    got = {r.column_name: r.unique_count for r in profile.profile_columns(df).collect()}
    assert got == {f"c{i}": i + 2 for i in range(9)}
