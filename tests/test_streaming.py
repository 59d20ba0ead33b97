"""Streaming forms compared with the batch queries on the same rows."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from quarry import streaming
from quarry.operators import sequence, usage


def _stream_copy(spark, n_files=4):
    d = tempfile.mkdtemp(prefix="quarry-stream-")
    src = usage.usage_from_events(spark.read.parquet(f"{SF001}/events.parquet")).drop("props")
    src.repartition(n_files, "event_id").write.parquet(os.path.join(d, "in"))
    return d, src


def test_windowed_usage_matches_batch(spark):
    d, src = _stream_copy(spark)
    stream = streaming.file_stream(spark, os.path.join(d, "in"), src.schema,
                                   max_files_per_trigger=1)
    q = streaming.start(streaming.windowed_usage(stream, "1 hour", None),
                        os.path.join(d, "ck"), "batch", "memory", "win_out",
                        output_mode="complete")
    q.awaitTermination()
    got = spark.table("win_out")
    batch = usage.downsample(src.withColumnRenamed("amount", "value"), "ts", "value",
                             ["organization_id", "resource_type"], "1 hour")
    assert got.count() == batch.count()
    j = got.join(batch, ["organization_id", "resource_type", "window_start"])
    assert j.where(F.abs(F.col("total") - F.col("sum")) > 1e-6).count() == 0


def test_usage_batch_writer_idempotent(spark):
    d, src = _stream_copy(spark, 2)
    w = streaming.usage_batch_writer(os.path.join(d, "out"))
    part = src.limit(100)
    w(part, 7)
    w(part, 7)   # replay of the same batch id
    out = spark.read.parquet(os.path.join(d, "out", "usage"))
    assert out.agg(F.sum("record_count")).first()[0] == 100


def test_suppress_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="quarry-sup-")
    ev = spark.read.parquet(f"{SF001}/events.parquet").where(F.col("value") >= 60)
    v = ev.select(F.col("event_id").alias("id"),
                  F.concat(F.lit("org_"), (F.col("user_id") % 3).cast("string"))
                  .alias("organization_id"), F.col("event_type").alias("resource_type"),
                  F.lit("exceeded").alias("violation_type"), F.col("ts").cast("timestamp"))
    v.write.parquet(os.path.join(d, "in"))
    stream = streaming.file_stream(spark, os.path.join(d, "in"), v.schema)
    q = streaming.start(streaming.suppress_stream(stream), os.path.join(d, "ck"), "batch",
                        "memory", "sup_out")
    q.awaitTermination()
    got = {r.id for r in spark.table("sup_out").collect()}
    want = {r.id for r in sequence.suppress_repeats(
        v, ["organization_id", "resource_type", "violation_type"], "ts", "id")
        .where("emitted").collect()}
    assert got == want


def test_flag_stream_row_rules(spark):
    from quarry.operators.quality import Rule

    d, src = _stream_copy(spark, 2)
    stream = streaming.file_stream(spark, os.path.join(d, "in"), src.schema)
    flagged = streaming.flag_stream(stream, [Rule("r", "range_check", "amount",
                                                  {"min_value": 0, "max_value": 100})])
    q = streaming.start(flagged, os.path.join(d, "ck"), "batch", "memory", "flag_out")
    q.awaitTermination()
    bad = spark.table("flag_out").where(F.size("_failed_rules") > 0).count()
    assert bad == src.where(F.col("amount") > 100).count()


def test_foreach_batch_usage_and_rules_in_stream(spark):
    """X3 + X7 inside a running stream: two micro-batches (one file each)
    roll usage up and write per-batch rule results, idempotent per batch."""
    from quarry.operators.quality import Rule

    d, src = _stream_copy(spark, 2)
    quotas = spark.createDataFrame([("org_0", "click", 100.0, 0.8, "daily")],
                                   "organization_id string, resource_type string, "
                                   "quota_limit double, warning_threshold double, "
                                   "reset_period string")
    stream = streaming.file_stream(spark, os.path.join(d, "in"), src.schema,
                                   max_files_per_trigger=1)
    usage_w = streaming.usage_batch_writer(os.path.join(d, "out"))
    quota_w = streaming.quota_batch_writer(os.path.join(d, "quota"), quotas)
    rules_w = streaming.rules_batch_writer([Rule("c", "completeness", "amount")],
                                           os.path.join(d, "rules"))

    def both(batch, batch_id):
        usage_w(batch, batch_id)
        quota_w(batch, batch_id)
        rules_w(batch, batch_id)

    q = streaming.start(stream, os.path.join(d, "ck"), "batch", foreach_batch=both)
    q.awaitTermination()
    rolled = spark.read.parquet(os.path.join(d, "out", "usage"))
    assert rolled.agg(F.sum("record_count")).first()[0] == src.count()
    assert rolled.select("batch_id").distinct().count() == 2
    res = spark.read.parquet(os.path.join(d, "rules"))
    assert res.agg(F.sum("total_records")).first()[0] == src.count()
    v = spark.read.parquet(os.path.join(d, "quota", "violations"))
    assert set(v.columns) >= {"violation_type", "action_taken", "batch_id"}


def test_cdc_stream(spark):
    """A change feed applied per micro-batch, latest change per key wins."""
    d = tempfile.mkdtemp(prefix="quarry-cdc-")
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_orderstatus")
    first = o.select("o_orderkey", "o_orderstatus", F.lit(1).alias("ver"), F.lit("u").alias("op"))
    second = o.where(F.col("o_orderkey") % 10 == 0).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("ver"),
        F.when(F.col("o_orderkey") % 20 == 0, "d").otherwise("u").alias("op"))
    first.write.parquet(os.path.join(d, "in", "b1"))
    second.write.parquet(os.path.join(d, "in", "b2"))
    stream = (spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(d, "in")))
    q = streaming.start(stream, os.path.join(d, "ck"), "batch",
                        foreach_batch=streaming.cdc_batch_writer(os.path.join(d, "t"),
                                                                 ["o_orderkey"], "ver"))
    q.awaitTermination()
    t = streaming.latest_version(spark, os.path.join(d, "t"))
    assert t.count() == o.where(F.col("o_orderkey") % 20 != 0).count()
    assert t.where("o_orderstatus = 'X'").count() == o.where(
        (F.col("o_orderkey") % 10 == 0) & (F.col("o_orderkey") % 20 != 0)).count()


def test_pipeline_spec_runs_as_stream(spark):
    """The batch pipeline spec applied to a file stream (availableNow)."""
    from quarry.operators.quality import Rule
    from quarry.plans.runner import PipelineSpec, build, run_streaming

    d, src = _stream_copy(spark, 3)
    spec = PipelineSpec(source={"format": "parquet", "path": os.path.join(d, "in")},
                        transforms=[{"type": "filter", "condition": "amount > 10"},
                                    {"type": "add_column", "name": "cents",
                                     "expression": "cast(amount * 100 as bigint)"}],
                        rules=[Rule("r", "range_check", "amount", {"max_value": 100})],
                        target={"path": os.path.join(d, "out")}, organization="org_9")
    q = run_streaming(spark, spec, os.path.join(d, "ck"), "batch", schema=src.schema,
                      max_files_per_trigger=1)
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(d, "out"))
    batch = build(spark, PipelineSpec(source={"frame": src}, transforms=spec.transforms))
    assert out.count() == batch.count()
    assert out.where(F.size("_failed_rules") > 0).count() == batch.where("amount > 100").count()
    assert out.select("organization").distinct().first()[0] == "org_9"


def test_quota_flow_suppresses_within_the_hour(spark):
    """3.3: usage -> quota -> violation per batch; a repeated violation of
    the same key within an hour of the last recorded one is not recorded."""
    import datetime as dt

    d = tempfile.mkdtemp(prefix="quarry-quota-")
    quotas = spark.createDataFrame([("o", "api_calls", 10.0, 0.8, "monthly")],
                                   "organization_id string, resource_type string, "
                                   "quota_limit double, warning_threshold double, "
                                   "reset_period string")
    w = streaming.quota_batch_writer(d, quotas)
    schema = "organization_id string, resource_type string, amount double, ts timestamp"
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    batches = [[("o", "api_calls", 11.0, t0)],                          # exceeded -> recorded
               [("o", "api_calls", 1.0, t0 + dt.timedelta(minutes=30))],  # within 1 h -> no
               [("o", "api_calls", 1.0, t0 + dt.timedelta(minutes=90))]]  # 90 min -> recorded
    for i, rows in enumerate(batches):
        w(spark.createDataFrame(rows, schema), i)
    w(spark.createDataFrame(batches[1], schema), 1)                      # replay is harmless
    v = spark.read.parquet(os.path.join(d, "violations")).orderBy("batch_id").collect()
    assert [r.batch_id for r in v] == [0, 2]
    assert all(r.violation_type == "exceeded" and r.action_taken == "rate_limit_api" for r in v)
    assert v[1].current_usage == 13.0


def test_suppress_stream_state_across_batches(spark):
    """X6 with one file per trigger in time order: the last emitted time per
    key is carried in state from batch to batch."""
    import time as _time

    d = tempfile.mkdtemp(prefix="quarry-sup2-")
    ev = spark.read.parquet(f"{SF001}/events.parquet").where(F.col("value") >= 40)
    v = ev.select(F.col("event_id").alias("id"),
                  F.concat(F.lit("org_"), (F.col("user_id") % 2).cast("string"))
                  .alias("organization_id"), F.lit("r").alias("resource_type"),
                  F.lit("exceeded").alias("violation_type"), F.col("ts").cast("timestamp"))
    days = [r[0] for r in v.select(F.to_date("ts")).distinct().orderBy(1).collect()]
    for i, chunk in enumerate([days[j:j + 10] for j in range(0, len(days), 10)]):
        v.where(F.to_date("ts").isin(chunk)).coalesce(1).write.parquet(
            os.path.join(d, "in", f"part{i:02d}"))
        _time.sleep(1.1)       # distinct modification times keep the file order
    stream = (spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(d, "in")))
    q = streaming.start(streaming.suppress_stream(stream), os.path.join(d, "ck"), "batch",
                        "memory", "sup_out2")
    q.awaitTermination()
    got = {r.id for r in spark.table("sup_out2").collect()}
    want = {r.id for r in sequence.suppress_repeats(
        v, ["organization_id", "resource_type", "violation_type"], "ts", "id")
        .where("emitted").collect()}
    assert got == want
