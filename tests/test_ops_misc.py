"""Sources, sinks, transforms, privacy, tenant scope, lineage, catalog."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry import sinks
from quarry.functions import periods, privacy, text
from quarry.operators import access, catalog, lineage, monitoring, remediate, transforms, usage
from quarry.operators.quality import Rule, row_flags
from quarry.sources import files, introspect
from quarry.tenant import TenantScope, leaks


def tmp():
    return tempfile.mkdtemp(prefix="quarry-t-")


def test_scan_formats_and_suffix(spark):
    d = tmp()
    df = spark.read.parquet(f"{SF001}/nation.parquet")
    df.write.csv(os.path.join(d, "n.csv"), header=True)
    df.write.json(os.path.join(d, "n.json"))
    assert files.scan_file(spark, os.path.join(d, "n.csv"), "csv", infer_schema=True).count() == 25
    assert files.read_by_suffix(spark, os.path.join(d, "n.json")).count() == 25
    with pytest.raises(files.SourceError):
        files.scan_file(spark, d, "avro")
    with pytest.raises(files.SourceError):
        files.read_by_suffix(spark, os.path.join(d, "n.txt"))
    listing = files.list_objects(spark, d, "*.csv")
    assert listing.count() >= 1 and set(listing.columns) >= {"key", "size", "last_modified"}


def test_delimited_and_tenant_dataset(spark):
    d = tmp()
    df = spark.read.parquet(f"{SF001}/region.parquet")
    df.write.option("sep", "|").option("header", True).csv(os.path.join(d, "r"))
    assert files.scan_format(spark, os.path.join(d, "r"), "delimited").count() == 5
    os.makedirs(os.path.join(d, "t1", "datasets"))
    df.toPandas().to_csv(os.path.join(d, "t1", "datasets", "region.csv"), index=False)
    assert files.read_tenant_dataset(spark, d, "t1", "region").count() == 5
    assert files.read_tenant_dataset(spark, d, "t1", "missing") is None


def test_transform_chain_rejects_unknown(spark):
    df = spark.read.parquet(f"{SF001}/orders.parquet")
    with pytest.raises(transforms.TransformError):
        transforms.apply_transforms(df, [{"type": "explode_everything"}])
    assert transforms.apply_transforms(df, []) is df


def test_parameterized_sql_missing(spark):
    with pytest.raises(transforms.TransformError):
        transforms.parameterized_sql(spark, "SELECT '${a}'", {})


def test_cast_columns_flags(spark):
    df = spark.createDataFrame([("1", "x"), ("2.5", "2024-01-01"), (None, "bad")],
                               "a string, b string")
    out = transforms.cast_columns(df, {"a": "int", "b": "date"}).collect()
    assert out[0]._cast_errors == ["b"] and out[1]._cast_errors == ["a"]
    assert out[2]._cast_errors == ["b"]


def test_high_water_mark(spark):
    df = spark.read.parquet(f"{SF001}/orders.parquet")
    hwm = transforms.high_water_mark(df, "o_orderkey", "orders").first()
    assert int(hwm.last_value) == df.agg(F.max("o_orderkey")).first()[0]
    assert transforms.incremental_filter(df, "o_orderkey", int(hwm.last_value)).count() == 0


def test_quarantine_partition_is_complete(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    rules = [Rule("r", "range_check", "l_discount", {"min_value": 0, "max_value": 0.05}),
             Rule("u", "uniqueness", None, {"columns": ["l_orderkey", "l_linenumber"]})]
    good, bad = remediate.quarantine_split(li, rules)
    assert good.count() + bad.count() == li.count()
    assert good.exceptAll(li).count() == 0


def test_merge_and_cdc(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    s = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, ver int")
    m = {r.k: r.v for r in sinks.merge_frames(t, s, ["k"], [F.col("ver")]).collect()}
    assert m == {1: "a", 2: "d", 3: "e"}
    from quarry import streaming

    d = tmp()
    w = streaming.cdc_batch_writer(d, ["k"], "ver")
    w(spark.createDataFrame([(1, "a", 1, "u"), (2, "b", 1, "u")],
                            "k int, v string, ver int, op string"), 0)
    w(spark.createDataFrame([(1, "x", 2, "d"), (3, "c", 1, "u")],
                            "k int, v string, ver int, op string"), 1)
    assert {r.k for r in streaming.latest_version(spark, d).collect()} == {2, 3}


def test_write_run_and_snapshots(spark):
    d = tmp()
    df = spark.read.parquet(f"{SF001}/region.parquet")
    sinks.write_run(df, d, "run1")
    sinks.write_run(df, d, "run2")
    snaps = {r.snapshot_id for r in catalog.snapshots(spark, d).collect()}
    assert snaps == {"run1", "run2"}


def test_privacy(spark):
    df = spark.createDataFrame([("mail a.b@ex.com or 555-12-3456, card 1234 5678 9012 3456",)],
                               "t string")
    counts = df.select(*[v.alias(k) for k, v in privacy.pii_counts(F.col("t")).items()]).first()
    assert counts.email == 1 and counts.ssn == 1 and counts.card == 1
    masked = df.select(privacy.mask_pii(F.col("t")).alias("m")).first().m
    assert "[EMAIL]" in masked and "@" not in masked
    enc = df.select(privacy.decrypt(privacy.encrypt(F.col("t"), "0123456789abcdef"),
                                    "0123456789abcdef").alias("x")).first().x
    assert enc == df.first().t
    cfg = spark.createDataFrame([("u", "p", {"api_key": "k", "host": "h"})],
                                "user string, password string, opts map<string,string>")
    m = privacy.mask_sensitive(cfg).first()
    assert m.password == "***" and m.opts["api_key"] == "***" and m.opts["host"] == "h"


def test_tenant_scope_isolation(spark):
    u = usage.usage_from_events(spark.read.parquet(f"{SF001}/events.parquet"))
    scoped = TenantScope("org_2").read(u)
    assert leaks(scoped, "org_2").count() == 0 and scoped.count() > 0


def test_lineage_cycles_and_jobs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    w = lineage.closure(spark, e, "downstream")
    assert w.where("root = 'a'").count() == 2          # b and c, cycle stopped
    jobs = spark.createDataFrame([(1, "success", []), (2, "pending", [1]), (3, "pending", [2]),
                                  (4, "pending", [])],
                                 "job_id int, status string, depends_on array<int>")
    assert {r.job_id for r in lineage.runnable_jobs(jobs).collect()} == {2, 4}


def test_access_wildcards(spark):
    roles = spark.createDataFrame([("r", ["events:*"])], "role string, permissions array<string>")
    ur = spark.createDataFrame([(1, "r", True), (2, "r", False)],
                               "user_id int, role string, is_active boolean")
    req = spark.createDataFrame([(1, 1, "events", "write"), (2, 1, "x", "read"),
                                 (3, 2, "events", "read")],
                                "request_id int, user_id int, resource string, action string")
    got = {r.request_id: r.allowed for r in access.check_requests(req, ur, roles).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_health_rollup_rules(spark):
    svc = spark.createDataFrame([("a", True), ("b", False)], "service_name string, critical boolean")
    res = spark.createDataFrame([("g", "b", "unhealthy"), ("g", "a", "degraded"),
                                 ("h", "b", "unhealthy"), ("i", "z", "unhealthy"),
                                 ("j", "a", "unknown")],
                                "g string, service_name string, status string")
    got = {r.g: r.overall_status for r in monitoring.health_rollup(res, svc, ["g"]).collect()}
    assert got == {"g": "degraded", "h": "healthy", "i": "unhealthy", "j": "healthy"}


def test_period_and_text_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 15, 20), " 1.2.3.4 , 5.6.7.8", "orders",
                                 "all orders")], "ts timestamp, xff string, n string, d string")
    r = df.select(periods.period_start(F.col("ts"), "weekly").alias("w"),
                  periods.period_end(periods.period_start(F.col("ts"), "monthly"), "monthly")
                  .alias("me"),
                  text.first_forwarded_ip(F.col("xff")).alias("ip"),
                  text.search_score("order", F.col("n"), F.col("d")).alias("s"),
                  text.render_template("hi {{n}}", {"n": F.col("n")}).alias("t")).first()
    assert r.w == dt.datetime(2024, 1, 29) and r.me == dt.datetime(2024, 2, 1)
    assert r.ip == "1.2.3.4" and r.s == 1.0 and r.t == "hi orders"


def test_catalog_ddl(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    catalog.create_schema(spark, "qtest", comment="tests")
    schema = StructType([StructField("id", LongType(), False),
                         StructField("tenant_id", StringType(), True)])
    catalog.create_table(spark, "qtest.t1", schema, partition_columns=["tenant_id"])
    cols = introspect.catalog_columns(spark, "qtest")
    assert {r.column_name for r in cols.collect()} == {"id", "tenant_id"}


def test_document_schema_and_preview(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1.5}',), ("not json",)],
                               "j string")
    got = {r.field: r.types for r in introspect.infer_document_schema(df, "j").collect()}
    assert got == {"a": "double,integer", "b": "string"}
    p = introspect.preview(df, 2)
    assert len(p["rows"]) == 2 and p["total_count"] is None


def test_auto_fix_and_dedupe(spark):
    df = spark.createDataFrame([(1, 5.0, " A@B.COM "), (1, -1.0, "bad"), (2, None, None)],
                               "k int, v double, e string")
    fixed = remediate.auto_fix(df, [Rule("r", "range_check", "v", {"min_value": 0,
                                                                  "max_value": 3}),
                                    Rule("c", "completeness", "v", {"default": 0.0}),
                                    Rule("e", "validity", "e", {"data_type": "email"})]).collect()
    assert [r.v for r in fixed] == [3.0, 0.0, 0.0]
    assert fixed[0].e == "a@b.com" and fixed[1].e is None
    d = remediate.dedupe_keep_first(df, ["k"], [F.col("v")]).collect()
    assert {(r.k, r.v) for r in d} == {(1, -1.0), (2, None)}


def test_row_flags_reasons(spark):
    df = spark.createDataFrame([("abc", 5), ("xyz", 50)], "s string, n int")
    out = row_flags(df, [Rule("v", "validity", "s", {"pattern": "a"}),
                         Rule("r", "validity", "n", {"range": {"max": 10}})]).collect()
    assert out[0]._failed_rules == [] and out[1]._failed_rules == ["v", "r"]
