"""State that has to survive replays, late changes and odd inputs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry import session, sinks, streaming
from quarry.operators import access, lineage, transforms, usage
from quarry.operators.quality import Rule
from quarry.plans.runner import PipelineSpec, run

CHANGE = "k int, v string, ver int, op string"


def folder():
    return tempfile.mkdtemp(prefix="quarry-state-")


def image(spark, path):
    return {r.k: (r.v, r.ver) for r in streaming.latest_version(spark, path).collect()}


def test_cdc_late_changes_deletes_and_replay(spark):
    d = folder()
    write = streaming.cdc_batch_writer(d, ["k"], "ver", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), CHANGE)
    write(rows((1, "a5", 5, "u"), (2, "b1", 1, "u"), (3, "c1", 1, "u"), (4, "d1", 1, "u")), 0)
    # a stale change, a delete, and a change that comes later than a newer one
    second = rows((1, "a3", 3, "u"), (2, "gone", 4, "d"), (3, "c2", 2, "u"), (3, "c0", 0, "u"))
    write(second, 1)
    want = {1: ("a5", 5), 3: ("c2", 2), 4: ("d1", 1)}
    assert image(spark, d) == want
    write(F.broadcast(second), 1)          # replayed, as a broadcast side
    write(second, 1)
    assert image(spark, d) == want
    write(rows((2, "late", 3, "u")), 2)    # older than the delete
    assert image(spark, d) == want
    write(rows((2, "new", 9, "u")), 3)
    assert image(spark, d) == {**want, 2: ("new", 9)}


def test_quota_over_batches_and_usage_without_quota(spark):
    d = folder()
    quotas = spark.createDataFrame(
        [("o", "api", 100.0, 0.8, "daily", True), ("o", "off", 1.0, 0.8, "daily", False)],
        "organization_id string, resource_type string, quota_limit double, "
        "warning_threshold double, reset_period string, is_active boolean")
    write = streaming.quota_batch_writer(d, quotas)
    rows = lambda h, n: spark.createDataFrame(
        [("o", "api", n, f"2024-01-05 {h}:00:00"), ("o", "off", n, f"2024-01-05 {h}:00:00"),
         ("o", "free", n, f"2024-01-05 {h}:00:00")],
        "organization_id string, resource_type string, amount double, t string") \
        .withColumn("ts", F.col("t").cast("timestamp"))
    write(rows("01", 60.0), 0)
    write(rows("05", 60.0), 1)
    v = spark.read.parquet(f"{d}/violations").collect()
    assert [(r.violation_type, r.current_usage) for r in v] == [("exceeded", 120.0)]
    used = spark.read.parquet(f"{d}/usage").groupBy("resource_type").agg(F.sum("amount").alias("n"))
    assert {r.resource_type: r.n for r in used.collect()} == {"api": 120.0, "off": 120.0,
                                                              "free": 120.0}


def test_table_write_goes_by_name(spark):
    spark.sql("DROP TABLE IF EXISTS state_t")
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.write_table(df, "state_t")
    sinks.write_table(spark.createDataFrame([("y", 2)], "b string, a int"), "state_t")
    assert {(r.a, r.b) for r in spark.table("state_t").collect()} == {(1, "x"), (2, "y")}
    with pytest.raises(ValueError):
        sinks.write_table(df.drop("b"), "state_t")
    spark.sql("DROP TABLE state_t")


def test_marks_in_their_own_order(spark):
    marks = spark.createDataFrame(
        [("s", "n", "999", "int"), ("s", "n", "1000", "int"), ("s", "n", None, "int"),
         ("s", "d", "2024-02-01", "date"), ("s", "d", "2024-10-01", "date"),
         ("s", "x", "9.5", "double"), ("s", "x", "1.0E10", "double")],
        "source string, column string, last_value string, value_type string")
    got = {r.column: r.last_value for r in transforms.latest_marks(marks).collect()}
    assert got == {"n": "1000", "d": "2024-10-01", "x": "1.0E10"}


def test_sql_transforms(spark):
    df = spark.createDataFrame([("a", 1), ("b{2}", 2)], "source string, n int")
    out = transforms.custom_sql(df, "SELECT source, n FROM source WHERE source LIKE '%{2}'")
    assert [tuple(r) for r in out.collect()] == [("b{2}", 2)]
    with pytest.raises(transforms.TransformError):
        transforms.parameterized_sql(spark, "SELECT * FROM {d} WHERE source LIKE '%${x}%'",
                                     {"x": "a"}, d=df)


def test_lineage_shapes(spark):
    e = [(f"n{i:02}", f"n{i + 1:02}") for i in range(25)]
    chain = spark.createDataFrame(e, "source string, target string")
    root = spark.createDataFrame([("n00",)], "root string")
    got = lineage.closure(spark, chain, "downstream", root).collect()
    assert {(r.node, r.depth) for r in got} == {(f"n{i:02}", i) for i in range(1, 26)}
    assert lineage.closure(spark, chain, "upstream").count() == 25 * 26 // 2
    diamonds = spark.createDataFrame(
        [(f"{a}{i}", f"{b}{i}") for i in range(3) for a, b in ("sx", "sy", "xt", "yt")] +
        [("t0", "s1"), ("t1", "s2"), ("t2", "s0")], "source string, target string")
    got = lineage.closure(spark, diamonds, "downstream",
                          spark.createDataFrame([("s0",)], "root string")).collect()
    assert len(got) == 11 and len({r.node for r in got}) == 11


def test_intermediate_tables_are_freed(spark):
    base = session.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    lineage.closure(spark, chain).count()
    assert len(set(os.listdir(base)) - before) == 1    # the result's own table


def test_access_conditions(spark):
    roles = spark.createDataFrame([("m", ["doc:read:same_org", "doc:edit:owner_only"])],
                                  "role string, permissions array<string>")
    ur = spark.createDataFrame([(1, "m", True, "a", None), (2, "m", True, "a", "2024-01-01")],
                               "user_id long, role string, is_active boolean, "
                               "organization_id string, until string") \
        .withColumn("expires_at", F.col("until").cast("timestamp"))
    req = spark.createDataFrame(
        [(1, 1, "doc", "read", "a", None), (2, 1, "doc", "read", "b", None),
         (3, 1, "doc", "read", None, None), (4, 1, "doc", "edit", "b", 1),
         (5, 1, "doc", "edit", "a", 2), (6, 2, "doc", "read", "a", None)],
        "request_id long, user_id long, resource string, action string, "
        "organization_id string, owner_id long")
    got = {r.request_id for r in access.check_requests(req, ur, roles, "2024-06-01")
           .where("allowed").collect()}
    assert got == {1, 3, 4}


def test_storage_is_a_gauge(spark):
    u = spark.createDataFrame(
        [("o", "st", 10.0 * 1024 ** 3, "2024-01-01 10:00:00"),
         ("o", "st", 12.0 * 1024 ** 3, "2024-01-02 10:00:00"),
         ("o", "nodes", 3.0, "2024-01-02 10:57:00"), ("o", "nodes", 7.0, "2024-01-02 10:30:00")],
        "organization_id string, resource_type string, amount double, t string") \
        .withColumn("ts", F.col("t").cast("timestamp"))
    r = usage.usage_snapshot(u, "2024-01-02 11:00:00", "dbu", "st", "nodes").first()
    assert (r.storage_gb, r.compute_nodes, r.dbu_usage) == (12.0, 3, 0.0)


def test_rules_that_a_run_cannot_apply_are_reported(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    spec = PipelineSpec(source={"frame": df}, rules=[
        Rule("sql", "custom_sql", None, {"sql_query": "SELECT * FROM {d}"},
             remediation="quarantine"),
        Rule("fix", "timeliness", "b", {}, remediation="auto_fix"),
        Rule("nul", "completeness", "b", remediation="quarantine")])
    got = run(spark, spec, "r1", {"d": df})
    assert got["unflagged_rules"] == ["sql"] and got["records_processed"] == 1
    assert got["failed_records"] == 1
    with pytest.raises(ValueError):
        streaming.flag_stream(df, [Rule("u", "uniqueness", "a")])
