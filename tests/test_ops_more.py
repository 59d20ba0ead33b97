"""Remaining operators: schema diff, named checks, reports, sinks, sources."""

import json

import pytest
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from conftest import SF001
from quarry import sinks
from quarry.operators import monitoring, remediate, runs, usage
from quarry.operators.quality import (Rule, check_record, register_row_check, rule_from_row,
                                      run_rules, schema_diff, select_rules)
from quarry.sources import external, files, introspect


def tmp():
    return tempfile.mkdtemp(prefix="quarry-m-")


def test_schema_diff(spark):
    df = spark.read.parquet(f"{SF001}/region.parquet")
    exp = StructType([StructField("r_regionkey", LongType()), StructField("r_comment", StringType())])
    got = {(r.column_name, r.issue) for r in schema_diff(exp, df).collect()}
    assert got == {("r_comment", "missing"), ("r_name", "extra"), ("r_regionkey", "type_changed")}


def test_named_python_check(spark):
    @F.pandas_udf("boolean")
    def even(s: pd.Series) -> pd.Series:
        return s % 2 == 0

    register_row_check("even", even)
    df = spark.range(10)
    r = run_rules(df, [Rule("p", "python", "id", {"check": "even", "threshold": 0.5})]).first()
    assert r.status == "passed" and r.failed_records == 5
    bad = run_rules(df, [Rule("q", "python", "id", {"check": "nope"})]).first()
    assert bad.status == "error"


def test_check_record_realtime(spark):
    r = check_record(spark, {"id": 1, "email": "x@y.org"},
                     [Rule("e", "validity", "email", {"data_type": "email"})]).first()
    assert r.status == "passed" and r.total_records == 1


def test_rule_rows_and_selection(spark):
    rows = [("1", "o1", "c", "completeness", "t", "name", json.dumps({"threshold": 0.9}), True),
            ("2", "o1", "u", "uniqueness", None, "id", "{}", True),
            ("3", "o2", "x", "completeness", "t", "name", "{}", True),
            ("4", "o1", "y", "completeness", "other", "name", "{}", True)]
    rules = spark.createDataFrame(rows, "id string, organization_id string, name string, "
                                        "rule_type string, table_name string, column_name string, "
                                        "rule_definition string, is_active boolean")
    sel = [rule_from_row(r) for r in select_rules(rules, "o1", "t").collect()]
    assert sorted(r.rule_id for r in sel) == ["1", "2"]
    assert [r for r in sel if r.rule_id == "1"][0].threshold() == 0.9


def test_reports_route_reject_incident(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, v string")
    rules = [Rule("c", "completeness", "v", remediation="reject"),
             Rule("k", "completeness", "id", remediation="manual_review")]
    res = run_rules(df, rules, ctx={"batch_id": "b1", "dataset_name": "d",
                                    "executed_at": "2024-01-02 00:00:00"})
    rules_df = spark.createDataFrame([(r.rule_id, r.remediation) for r in rules],
                                     "id string, remediation_action string")
    routed = remediate.route(res, rules_df)
    assert remediate.reject_batch(res, routed).first().run_status == "failed"
    assert remediate.incidents(routed).count() == 0
    assert remediate.alerts(routed).count() == 0
    rep = monitoring.search_reports(res, "d", "2024-01-01", "2024-01-03", 10)
    assert rep.count() == 2
    score = monitoring.overall_score(res).first()
    assert score.total_rules == 2 and score.overall_score == 0.5


def test_sinks_roundtrip(spark):
    d = tmp()
    df = spark.read.parquet(f"{SF001}/nation.parquet")
    sinks.write_files(df, os.path.join(d, "p"), partition_by=["n_regionkey"], rebalance=True)
    assert spark.read.parquet(os.path.join(d, "p")).count() == 25
    path = sinks.write_report(df, d, "20240101")
    assert spark.read.json(path).count() == 25
    payload = sinks.kafka_payload(df, "n_nationkey").first()
    assert json.loads(payload.value)["n_name"] and payload.key is not None
    sinks.write_documents(df, os.path.join(d, "docs"))
    got = external.document_read(spark, os.path.join(d, "docs"), query="n_regionkey = 1", limit=3)
    assert got.count() == 3
    flagged = df.withColumn("_failed_rules", F.when(F.col("n_nationkey") < 3, F.array(F.lit("r")))
                            .otherwise(F.array().cast("array<string>")))
    assert sinks.dead_letters(flagged).count() == 3


def test_managed_table_and_maintenance(spark):
    from quarry.operators import catalog

    df = spark.read.parquet(f"{SF001}/nation.parquet")
    spark.sql("DROP TABLE IF EXISTS nation_t")
    sinks.write_table(df, "nation_t", mode="overwrite", partition_by=["n_regionkey"])
    sinks.write_table(df.where("n_regionkey = 1"), "nation_t", mode="append")
    assert spark.table("nation_t").count() == 30
    catalog.analyze(spark, "nation_t")
    path = tempfile.mkdtemp(prefix="quarry-v-")
    sinks.publish_version(df.repartition(5), path)
    catalog.compact(spark, path)
    assert sinks.versions(spark, path) == [0, 1]
    assert sinks.read_version(spark, path).count() == 25
    assert len(sinks.read_version(spark, path).inputFiles()) == 1
    assert spark.table("nation_t").count() == 30


def test_parse_json_value_and_message_schema(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        F.col("event_id").cast("string").alias("key"), F.col("ts").alias("timestamp"),
        F.col("props").alias("value"))
    bad = spark.createDataFrame([("x", None, "not json")], ev.schema)
    parsed = external.parse_json_value(ev.unionByName(bad), "k long")
    assert parsed.where("_corrupt IS NOT NULL").count() == 1
    assert parsed.where("k IS NOT NULL").count() == ev.count()
    assert "k" in introspect.infer_message_schema(ev)


def test_scan_tables_incremental_and_metadata(spark):
    from quarry.operators.transforms import ingest_metadata

    got = files.scan_tables(spark, SF001, ["orders", "customer"], incremental_column=None)
    assert set(got) == {"orders", "customer"}
    inc = files.scan_tables(spark, SF001, ["orders"], incremental_column="o_orderkey",
                            last_values={"orders": 5})
    assert inc["orders"].agg(F.min("o_orderkey")).first()[0] > 5
    m = ingest_metadata(got["customer"], "org_1", "dev")
    assert {"ingestion_timestamp", "organization", "environment"} <= set(m.columns)


def test_connections_join(spark):
    p = spark.createDataFrame([(1, "t", 10, 11), (2, "u", 10, 11)],
                              "pipeline_id int, organization_id string, source_connection_id int, "
                              "target_connection_id int")
    c = spark.createDataFrame([(10, "t", "postgresql", True), (11, "t", "s3", True),
                               (10, "u", "mysql", True)],
                              "id int, organization_id string, connection_type string, "
                              "is_active boolean")
    out = runs.with_connections(p, c, "t").collect()
    assert len(out) == 1 and out[0].source_type == "postgresql" and out[0].target_type == "s3"


def test_pipeline_run_end_to_end(spark):
    from quarry.plans.runner import PipelineSpec, run

    d = tmp()
    spec = PipelineSpec(source={"format": "parquet", "path": f"{SF001}/lineitem.parquet"},
                        transforms=[{"type": "select", "columns": ["l_orderkey", "l_discount"]}],
                        rules=[Rule("r", "range_check", "l_discount",
                                    {"min_value": 0, "max_value": 0.05})],
                        target={"path": os.path.join(d, "out")}, organization="org_1",
                        quarantine=True)
    res = run(spark, spec, "run-1")
    good = spark.read.parquet(res["output"]).count()
    bad = spark.read.parquet(os.path.join(d, "out_quarantine", "run-1")).count()
    total = spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    assert good + bad == total and res["records_processed"] == good


def test_default_quotas_and_compliance(spark):
    orgs = spark.createDataFrame([("a", "low"), ("b", "weird")],
                                 "organization_id string, compliance_level string")
    q = usage.default_quotas(spark, orgs)
    assert q.count() == 14
    assert q.where("organization_id = 'b' AND resource_type = 'dbu_hours'").first().quota_limit \
        == 5000
    snap = spark.createDataFrame([("a", 5.0, 1.0, 1, 1.0, 4.0, 10.0, 5, 100.0)],
                                 "organization_id string, dbu_usage double, storage_gb double, "
                                 "compute_nodes int, cost_this_month double, max_dbu_per_hour double, "
                                 "max_storage_gb double, max_compute_nodes int, "
                                 "monthly_budget_usd double")
    assert usage.compliance(snap).first().violated == "DBU"


def test_audit_and_retention(spark):
    req = spark.createDataFrame(
        [(1, "t", "GET", "/api/x", 200, 5.0, "9.9.9.9, 1.1.1.1", "2024-01-01 00:00:00"),
         (1, "t", "GET", "/health", 200, 1.0, None, "2024-01-01 00:00:00")],
        "user_id int, tenant_id string, method string, path string, status_code int, "
        "duration_ms double, forwarded_for string, ts string")
    a = monitoring.audit_rows(req).collect()
    assert len(a) == 1 and a[0].ip_address == "9.9.9.9" and a[0].description == "GET /api/x"
    ret = spark.createDataFrame([(1, "2024-01-01"), (2, None), (3, "2025-01-01")],
                                "id int, retention_until string").withColumn(
        "retention_until", F.col("retention_until").cast("timestamp"))
    assert {r.id for r in monitoring.retention_purge(ret, "2024-06-01").collect()} == {2, 3}


def test_live_counters_stream(spark):
    from quarry import streaming

    d = tmp()
    u = usage.usage_from_events(spark.read.parquet(f"{SF001}/events.parquet")).drop("props")
    u.write.parquet(os.path.join(d, "in"))
    s = streaming.file_stream(spark, os.path.join(d, "in"), u.schema)
    q = streaming.start(streaming.live_counters(s, "1 hour", "1 second"), os.path.join(d, "ck"),
                        "batch", "memory", "live_out")
    q.awaitTermination()
    got = spark.table("live_out")
    batch = usage.session_totals(u, "1 hour")
    # sessions still open at the end of the input are not emitted in append mode
    assert 0 < got.count() <= batch.count()
    j = got.join(batch.withColumnRenamed("total", "bt"),
                 ["organization_id", "resource_type", "session_start"])
    assert j.where(F.abs(F.col("total") - F.col("bt")) > 1e-6).count() == 0


def test_lakehouse_prefix_join_business_rule(spark):
    from quarry.operators.transforms import apply_transforms

    spark.read.parquet(f"{SF001}/region.parquet").createOrReplaceTempView("region_v")
    assert external.lakehouse_table(spark, "region_v").count() == 5
    assert external.lakehouse_table(spark, "region_v", limit=2).count() == 2
    assert files.scan_prefix(spark, SF001 + "/nation.parquet").count() == 25
    n = spark.read.parquet(f"{SF001}/nation.parquet")
    r = spark.read.parquet(f"{SF001}/region.parquet").withColumnRenamed("r_regionkey",
                                                                        "n_regionkey")
    j = apply_transforms(n, [{"type": "join", "with": "region", "on": "n_regionkey",
                              "how": "left"}], {"region": r})
    assert j.where("r_name IS NULL").count() == 0 and j.count() == 25
    res = run_rules(n, [Rule("b", "accuracy", None, {"method": "business_rule",
                                                      "conditions": ["n_nationkey >= 0",
                                                                     "n_regionkey < 3"]})]).first()
    assert res.failed_records == n.where("n_regionkey >= 3").count()


def test_python_datasource_registration(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Numbers(DataSource):
        @classmethod
        def name(cls):
            return "quarry_numbers"

        def schema(self):
            return "n int"

        def reader(self, schema):
            return NumbersReader()

    class NumbersReader(DataSourceReader):
        def read(self, partition):
            for i in range(3):
                yield (i,)

    from quarry import sources

    sources.register_datasource(spark, Numbers)
    assert sources.create(spark, "quarry_numbers").count() == 3
    assert "quarry_numbers" in sources.list_connectors()


def test_metric_series_and_sliding_window(spark):
    from quarry import streaming
    from quarry.functions.periods import bytes_to_gb

    ev = spark.read.parquet(f"{SF001}/events.parquet")
    s = monitoring.metric_series(ev, "ts", "2024-01-02", "2024-01-03", "click", "event_type")
    ts = [r.ts for r in s.collect()]
    assert ts == sorted(ts) and len(ts) > 0
    assert ev.select(bytes_to_gb(F.lit(1024 ** 3)).alias("g")).first().g == 1.0
    d = tmp()
    u = usage.usage_from_events(ev).drop("props")
    u.write.parquet(os.path.join(d, "in"))
    st = streaming.file_stream(spark, os.path.join(d, "in"), u.schema)
    q = streaming.start(streaming.windowed_usage(st, "2 hours", None, "1 hour"),
                        os.path.join(d, "ck"), "batch", "memory", "slide_out",
                        output_mode="complete")
    q.awaitTermination()
    # every event lands in two overlapping 2-hour windows
    assert spark.table("slide_out").agg(F.sum("records")).first()[0] == 2 * u.count()


def test_top_values_all_matches_single(spark):
    from quarry.operators import profile

    c = spark.read.parquet(f"{SF001}/part.parquet")
    got = profile.top_values_all(c, ["p_name", "p_brand"], 5).collect()
    for col in ("p_name", "p_brand"):
        want = [(r.value, r["count"]) for r in profile.top_values(c, col, 5).collect()]
        have = [(r.value, r["count"]) for r in sorted(
            (r for r in got if r.column_name == col), key=lambda r: r.rank)]
        assert have == want


def test_split_write_one_job(spark):
    d = tmp()
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    rules = [Rule("r", "range_check", "l_discount", {"min_value": 0, "max_value": 0.05})]
    remediate.split_write(li, rules, os.path.join(d, "split"))
    out = spark.read.parquet(os.path.join(d, "split"))
    assert out.count() == li.count()
    assert out.where("_part = 'bad'").count() == li.where("l_discount > 0.05").count()


def test_quality_check_appends_results(spark):
    from quarry.plans.quality_check import run_quality_check

    d = tmp()
    rules = spark.createDataFrame([("r1", "t", "completeness", "ds", "v", "{}", "alert_only", True)],
                                  "id string, organization_id string, rule_type string, "
                                  "table_name string, column_name string, rule_definition string, "
                                  "remediation_action string, is_active boolean")
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    for b in ("b1", "b2"):
        run_quality_check(spark, rules, df, "t", "ds", b, results_path=os.path.join(d, "res"),
                          executed_at="2024-01-31 00:00:00")
    res = spark.read.parquet(os.path.join(d, "res"))
    assert res.count() == 2 and {r.batch_id for r in res.collect()} == {"b1", "b2"}
    assert res.first().organization_id == "t"


def test_exact_quantiles_multi_round(spark):
    """Distributed exact quantiles equal numpy's linear interpolation, with
    ties, nulls and a tiny candidate budget forcing several rounds."""
    import random

    import numpy as np

    from quarry.operators.profile import exact_quantiles

    rnd = random.Random(3)
    rows = [(rnd.gauss(0, 1) if i % 11 else None, float(rnd.randint(0, 5)), float(i))
            for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.column_name, r.q): r.value for r in
           exact_quantiles(df, ["a", "b", "c"], qs, grid=20, max_candidates=50).collect()}
    for j, c in enumerate("abc"):
        vals = np.array([r[j] for r in rows if r[j] is not None])
        for q in qs:
            assert got[(c, q)] == pytest.approx(float(np.percentile(vals, q * 100)), abs=1e-9)


def test_cluster_conf_sizing():
    from quarry.session import cluster_conf

    c = cluster_conf(100 * 1024 ** 4, 1000, 8)          # 100 TB on 1000 x 8 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    small = cluster_conf(10 * 1024 ** 2, 2, 4)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_pipeline_list_with_versions(spark):
    import datetime as dt

    p = spark.createDataFrame([(1, "a", "active"), (2, "b", "active")],
                              "pipeline_id int, name string, status string")
    r = spark.createDataFrame([(10, 1, dt.datetime(2024, 1, 1), "success"),
                               (11, 1, dt.datetime(2024, 1, 2), "failed")],
                              "run_id int, pipeline_id int, started_at timestamp, status string")
    v = spark.createDataFrame([(1, 1, True, dt.datetime(2024, 1, 1)),
                               (1, 2, True, dt.datetime(2024, 1, 3)),
                               (2, 1, False, dt.datetime(2024, 1, 1))],
                              "pipeline_id int, version int, is_current boolean, created_at timestamp")
    out = {x.pipeline_id: x for x in runs.pipeline_list(p, r, versions=v).collect()}
    assert out[1].last_run_id == 11 and out[1].current_version == 2
    assert out[2].last_run_id is None and out[2].current_version is None


def test_profile_edge_cases(spark):
    from quarry.operators import profile

    df = spark.createDataFrame([(None, 1.0, "a"), (None, 1.0, None)], "a double, b double, s string")
    p = {r.column_name: r for r in profile.profile_columns(df).collect()}
    assert p["a"].null_count == 2 and p["a"].median is None
    assert p["b"].median == 1.0 and p["b"].q25 == 1.0 and p["b"].std == 0.0
    assert p["s"].null_count == 1 and p["s"].max_length == 1
    empty = spark.createDataFrame([], "a double")
    e = profile.profile_columns(empty).first()
    assert e.null_count == 0 and e.median is None
