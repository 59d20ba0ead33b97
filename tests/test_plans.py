"""Physical-plan properties the design relies on (checked on the plan text)."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators.quality import Rule, run_rules
from quarry.plans import suite


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_flagship_pushes_filter_and_prunes_columns(spark):
    txt = formatted(suite.QUERIES["transform_chain_quality"](spark, SF001))
    assert "GreaterThan(o_totalprice,0.0)" in txt
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", txt)
    assert schemas and all(s == "struct<o_custkey:bigint,o_totalprice:double>" for s in schemas)


def test_scan_rules_fuse_into_one_scan(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    rules = [Rule(f"c{i}", "completeness", c) for i, c in enumerate(li.columns)]
    rules += [Rule("r", "range_check", "l_discount", {"min_value": 0, "max_value": 0.1}),
              Rule("x", "regex_pattern", "l_returnflag", {"pattern": "[AR]"}),
              Rule("t", "timeliness", "l_shipdate", {"max_age_hours": 24})]
    p = plan_of(run_rules(li, rules, as_of="2024-01-01 00:00:00"))
    assert p.count("FileScan parquet") == 1


def test_reference_rule_adds_one_join_not_a_scan_per_rule(spark):
    od = spark.read.parquet(f"{SF001}/orders.parquet")
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    rules = [Rule("a", "completeness", "o_custkey"),
             Rule("b", "reference_integrity", "o_orderkey",
                  {"reference_table": "li", "reference_column": "l_orderkey"}),
             Rule("c", "range_check", "o_totalprice", {"min_value": 0})]
    p = plan_of(run_rules(od, rules, frames={"li": li}))
    assert p.count("FileScan parquet") == 2          # orders once, reference once
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_wildcard_grants_are_equi_joins(spark):
    p = plan_of(suite.QUERIES["access_review"](spark, SF001))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_latest_per_key_has_no_window(spark):
    p = plan_of(suite.QUERIES["latest_run_per_key"](spark, SF001))
    assert "Window" not in p


def test_no_registered_query_plans_a_product_or_nested_loop(spark):
    for name, fn in suite.QUERIES.items():
        p = plan_of(fn(spark, SF001))
        assert "CartesianProduct" not in p, name
        assert "NestedLoop" not in p, name


def test_top_k_reports_use_take_ordered(spark):
    for name in ("top5_values", "catalog_search"):
        p = plan_of(suite.QUERIES[name](spark, SF001))
        assert "TakeOrderedAndProject" in p, name


def test_incremental_filter_reaches_the_scan(spark):
    from quarry.operators.transforms import incremental_filter

    df = incremental_filter(spark.read.parquet(f"{SF001}/orders.parquet"), "o_orderkey", 100)
    assert "GreaterThan(o_orderkey,100)" in formatted(df.select("o_orderkey"))


def test_tenant_filter_reaches_the_scan(spark, tmp_path):
    from quarry.tenant import TenantScope

    ev = spark.read.parquet(f"{SF001}/events.parquet").withColumn(
        "organization_id", F.concat(F.lit("org_"), (F.col("user_id") % 3).cast("string")))
    ev.write.partitionBy("organization_id").parquet(str(tmp_path / "ev"))
    scoped = TenantScope("org_1").read(spark.read.parquet(str(tmp_path / "ev")))
    txt = formatted(scoped)
    assert "PartitionFilters: [isnotnull(organization_id" in txt and "org_1" in txt
