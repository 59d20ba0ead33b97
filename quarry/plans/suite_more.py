"""Further registered queries: pipeline runs, change feeds, marks, conditions
and the smaller operators, each with an independent SQL text."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from quarry import session, sinks, streaming
from quarry.functions import periods, privacy
from quarry.functions.text import render_template
from quarry.operators import access, lineage, monitoring, remediate, runs, sequence, transforms, usage
from quarry.operators.quality import (Rule, check_record, run_rules, schema_diff)
from quarry.plans.runner import PipelineSpec
from quarry.plans.runner import run as run_pipeline
from quarry.plans.suite import (AS_OF, RESULT_COLS, RUNS_SQL, USAGE_SQL, VIOL_SQL, T,
                                _violation_candidates, register, rule_sql)
from quarry.sinks import versioned
from quarry.sources import files, introspect
from quarry.streaming import state


def _folder(spark) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(session.checkpoint_dir(spark), f"quarry-run-{uuid.uuid4().hex}")


# =========================================================== pipeline runs

def _orders(spark, d):
    return T(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("pr"))


ACTION_RULES = [
    Rule("pr_known", "completeness", "pr", remediation="alert_only"),
    Rule("status", "validity", "o_orderstatus", {"allowed_values": ["F", "O"]},
         remediation="quarantine"),
    Rule("price", "range_check", "o_totalprice",
         {"min_value": 1000, "max_value": 300000, "threshold": 1.0}, remediation="auto_fix"),
    Rule("one_each", "uniqueness", "o_custkey", remediation="manual_review"),
    Rule("positive", "range_check", "o_totalprice", {"min_value": 0}, remediation="reject"),
    Rule("big", "custom_sql", None, {"sql_query": "SELECT * FROM {o} WHERE o_totalprice < 0"},
         remediation="reject"),
]


@register("pipeline_run_actions", """
WITH o AS (SELECT *, nullif(o_orderpriority, '5-LOW') AS pr FROM orders),
k AS (SELECT * FROM o WHERE o_orderstatus IN ('F', 'O'))
SELECT 'status:' || CASE WHEN min(o_totalprice) >= 0 THEN 'success' ELSE 'failed' END AS item,
       1::BIGINT AS n FROM o
UNION ALL SELECT 'written', count(*) FROM k
UNION ALL SELECT 'written_cents', sum(round(greatest(1000, least(300000, o_totalprice)) * 100))
          ::BIGINT FROM k
UNION ALL SELECT 'quarantined', count(*) FROM o WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'alerts', (count(pr)::DOUBLE / count(*) < 0.95)::BIGINT FROM o
UNION ALL SELECT 'incidents', (count(DISTINCT o_custkey) < count(*))::BIGINT FROM o
UNION ALL SELECT 'failed_rules',
  ((SELECT count(pr)::DOUBLE / count(*) < 0.95 FROM o)::BIGINT +
   (SELECT count_if(o_orderstatus IN ('F', 'O')) < count(*) FROM o)::BIGINT +
   (SELECT count_if(o_totalprice BETWEEN 1000 AND 300000) < count(*) FROM o)::BIGINT +
   (SELECT count(DISTINCT o_custkey) < count(*) FROM o)::BIGINT)
UNION ALL SELECT 'runs', 1""")
def q_pipeline_run_actions(spark, d):
    """R1-R6, 3.1: a run whose failed rules alert, quarantine, fix, open an
    incident and (here passing) reject; what it wrote is read back."""
    base = _folder(spark)
    spec = PipelineSpec(source={"frame": _orders(spark, d)}, rules=ACTION_RULES,
                        target={"path": f"{base}/out"}, dataset_name="orders",
                        state_path=f"{base}/state")
    got = run_pipeline(spark, spec, "run1", {"o": _orders(spark, d)}, AS_OF)
    out = spark.read.parquet(f"{base}/out/run1")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("item"), "n")
    parts = [
        spark.read.parquet(f"{base}/state/runs").select(
            F.concat(F.lit("status:"), "status").alias("item"), F.lit(1).cast("long").alias("n")),
        count(out, "written"),
        out.agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("n"))
        .select(F.lit("written_cents").alias("item"), "n"),
        count(spark.read.parquet(f"{base}/out_quarantine/run1"), "quarantined"),
        count(got["alerts"], "alerts"), count(got["incidents"], "incidents"),
        count(got["results"].where("status = 'failed'"), "failed_rules"),
        count(spark.read.parquet(f"{base}/state/runs"), "runs")]
    return _union(parts)


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("pipeline_reject", """
SELECT 'failed' AS status, 0::BIGINT AS records_processed, 'cheap' AS rejected_by,
       false AS target_written, false AS mark_written,
       (SELECT count_if(o_totalprice > 100000) FROM orders)::BIGINT AS failed_records""")
def q_pipeline_reject(spark, d):
    """A failed rule with action reject: nothing reaches the target, the
    mark stays, results and run row are recorded."""
    base = _folder(spark)
    spec = PipelineSpec(
        source={"frame": T(spark, d, "orders")}, dataset_name="orders",
        rules=[Rule("cheap", "range_check", "o_totalprice", {"max_value": 100000},
                    remediation="reject"),
               Rule("key", "completeness", "o_orderkey", remediation="reject")],
        target={"path": f"{base}/out"}, state_path=f"{base}/state",
        incremental_column="o_orderkey")
    run_pipeline(spark, spec, "run1")
    row = spark.read.parquet(f"{base}/state/runs")
    bad = spark.read.parquet(f"{base}/state/results").where("rule_id = 'cheap'") \
        .select("run_id", "failed_records")
    return row.drop("failed_records").join(bad, "run_id").select(
        "status", "records_processed", F.array_join("rejected_by", ",").alias("rejected_by"),
        F.lit(streaming._exists(spark, f"{base}/out")).alias("target_written"),
        F.lit(streaming._exists(spark, f"{base}/state/marks")).alias("mark_written"),
        "failed_records")


@register("pipeline_incremental", """
WITH m AS (SELECT quantile_disc(o_orderkey, 0.5) AS k FROM orders)
SELECT 'run1' AS run_id, count_if(o_orderkey <= k)::BIGINT AS records_processed,
       max(CASE WHEN o_orderkey <= k THEN o_orderkey END) AS mark FROM orders, m
UNION ALL SELECT 'run2', count_if(o_orderkey > k), max(o_orderkey) FROM orders, m
UNION ALL SELECT 'run3', 0, NULL""")
def q_pipeline_incremental(spark, d):
    """P11/P12 in the run: each run reads what lies behind the last mark; a
    run without new rows leaves the mark as it is."""
    base, o = _folder(spark), T(spark, d, "orders")
    half = o.select(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey)")).first()[0]
    spec = PipelineSpec(source={"frame": o.where(F.col("o_orderkey") <= half)},
                        dataset_name="orders", target={"path": f"{base}/out"},
                        state_path=f"{base}/state", incremental_column="o_orderkey")
    run_pipeline(spark, spec, "run1")
    spec.source = {"frame": o}
    run_pipeline(spark, spec, "run2")
    run_pipeline(spark, spec, "run3")
    wrote = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out") \
        .withColumn("run_id", F.regexp_extract("_metadata.file_path", r"/out/([^/]+)/", 1))
    marks = wrote.groupBy("run_id").agg(F.max("o_orderkey").alias("mark"))
    return spark.read.parquet(f"{base}/state/runs").select("run_id", "records_processed") \
        .join(marks, "run_id", "left")


@register("consistency_row_errors", "\nUNION ALL ".join([
    rule_sql("div", "count_if(CASE WHEN l_linenumber - 1 <> 0 THEN "
             "l_quantity / (l_linenumber - 1) > 10 ELSE false END)", "count(*)", 1.0, "lineitem",
             1.0),
    rule_sql("cast", "count_if(coalesce(try_cast(l_returnflag || (l_linenumber - 3)::VARCHAR "
             "AS INT), -1) >= 0)", "count(*)", 1.0, "lineitem", 1.0)]))
def q_consistency_row_errors(spark, d):
    """Rows whose condition divides by zero or casts no number are
    inconsistent rows; the run goes on."""
    return run_rules(T(spark, d, "lineitem"), [
        Rule("div", "consistency", None, {"condition": "l_quantity / (l_linenumber - 1) > 10"}),
        Rule("cast", "consistency", None, {
            "condition": "cast(concat(l_returnflag, l_linenumber - 3) AS int) >= 0"}),
    ]).select(*RESULT_COLS)


# =========================================================== changes and marks

@register("cdc_apply", """
WITH c AS (
  SELECT o_custkey AS k, o_orderkey AS ver, o_totalprice AS v, o_orderstatus = 'P' AS del
  FROM orders)
SELECT k, ver, v FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY ver DESC) AS rn FROM c)
WHERE rn = 1 AND NOT del""")
def q_cdc_apply(spark, d):
    """Three batches of changes out of order, the last one replayed: the
    newest change of a key holds, deletes stay deleted."""
    path = _folder(spark)
    c = T(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ver"),
        F.col("o_totalprice").alias("v"),
        F.when(F.col("o_orderstatus") == "P", "d").otherwise("u").alias("op"))
    write = streaming.cdc_batch_writer(path, ["k"], "ver", buckets=8)
    for batch, part in enumerate((2, 0, 1, 1)):
        write(c.where(F.pmod(F.xxhash64("ver"), F.lit(3)) == part), min(batch, 2))
    return streaming.latest_version(spark, path).select("k", "ver", "v")


@register("latest_mark", """
SELECT l_returnflag AS source, 'l_orderkey' AS "column", max(l_orderkey)::VARCHAR AS last_value
FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_shipdate', strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S')
FROM lineitem GROUP BY 1""")
def q_latest_mark(spark, d):
    """The largest of many stored marks, numbers as numbers."""
    li = T(spark, d, "lineitem")
    marks = [li.select(F.col("l_returnflag").alias("source"), F.lit(c).alias("column"),
                       F.col(c).cast("string").alias("last_value"),
                       F.lit(li.schema[c].dataType.simpleString()).alias("value_type"))
             for c in ("l_orderkey", "l_shipdate")]
    out = transforms.latest_marks(marks[0].unionByName(marks[1]))
    return out.select("source", "column", F.when(
        F.col("column") == "l_shipdate", F.substring("last_value", 1, 19))
        .otherwise(F.col("last_value")).alias("last_value"))


@register("versioned_merge", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
FROM orders WHERE o_orderkey % 15 <> 0""")
def q_versioned_merge(spark, d):
    """K7: two merges, each published as the next version of the table."""
    path = _folder(spark)
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.merge_into_path(path, o, ["o_orderkey"])
    up = o.where("o_orderkey % 10 = 0 OR o_orderkey % 15 = 0").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"),
        (F.col("o_orderkey") % 15 == 0).alias("gone"))
    sinks.merge_into_path(path, up, ["o_orderkey"], delete_col="gone")
    return sinks.read_version(spark, path)


@register("violations_resolved_all", f"""
WITH RECURSIVE v AS (SELECT *, id % 3 = 0 AS done FROM {VIOL_SQL}),
nx AS (SELECT a.id, (SELECT b.id FROM v b WHERE b.organization_id = a.organization_id
          AND b.resource_type = a.resource_type AND b.violation_type = a.violation_type
          AND CASE WHEN a.done THEN (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id))
                   ELSE b.ts > a.ts + INTERVAL 1 HOUR END
          ORDER BY b.ts, b.id LIMIT 1) AS nid FROM v a),
roots AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY organization_id,
          resource_type, violation_type ORDER BY ts, id) AS rn FROM v) WHERE rn = 1),
chain(id) AS (SELECT id FROM roots UNION ALL
              SELECT nx.nid FROM chain JOIN nx ON nx.id = chain.id WHERE nx.nid IS NOT NULL)
SELECT v.id, v.organization_id, v.resource_type, v.violation_type, v.ts, v.done
FROM v JOIN chain USING (id)""")
def q_violations_resolved_all(spark, d):
    """A resolved violation suppresses nothing, all violations judged."""
    v = _violation_candidates(spark, d).withColumn("done", F.col("id") % 3 == 0)
    out = sequence.suppress_repeats(v, ["organization_id", "resource_type", "violation_type"],
                                    "ts", "id", 3600, resolved="done")
    return out.where("emitted").select("id", "organization_id", "resource_type",
                                       "violation_type", "ts", "done")


# =========================================================== state of streams

@register("violations_suppressed_stream", f"""
WITH RECURSIVE v AS (SELECT *, id % 3 = 0 AS done FROM {VIOL_SQL}),
nx AS (SELECT a.id, (SELECT b.id FROM v b WHERE b.organization_id = a.organization_id
          AND b.resource_type = a.resource_type AND b.violation_type = a.violation_type
          AND CASE WHEN a.done THEN (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id))
                   ELSE b.ts > a.ts + INTERVAL 1 HOUR END
          ORDER BY b.ts, b.id LIMIT 1) AS nid FROM v a),
roots AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY organization_id,
          resource_type, violation_type ORDER BY ts, id) AS rn FROM v) WHERE rn = 1),
chain(id) AS (SELECT id FROM roots UNION ALL
              SELECT nx.nid FROM chain JOIN nx ON nx.id = chain.id WHERE nx.nid IS NOT NULL)
SELECT v.id, v.organization_id, v.resource_type, v.violation_type, v.ts, v.done
FROM v JOIN chain USING (id)""")
def q_violations_suppressed_stream(spark, d):
    """Suppression over micro-batches in order of time (one replayed), from
    the states the batch before left; a resolved violation suppresses nothing."""
    base = _folder(spark)
    v = _violation_candidates(spark, d).withColumn("done", F.col("id") % 3 == 0)
    cuts = v.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")),
                                        [0.3, 0.4, 0.8]).alias("c")).first().c
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    write = state.suppression_writer(base, resolved="done")
    for batch, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = v.where((F.lit(True) if low is None else t > low) &
                       (F.lit(True) if high is None else t <= high))
        write(part, batch)
        if batch == 2:
            write(part, batch)
    return spark.read.parquet(f"{base}/emitted").select(
        "id", "organization_id", "resource_type", "violation_type", "ts", "done")


@register("running_totals", f"""
SELECT organization_id, resource_type, date_trunc('day', ts) AS period_start,
       round(sum(amount), 4) AS usage, count(*) AS records,
       arg_max(json_extract_string(props, '$.k'), {{'t': ts, 'i': event_id}}) AS meta_k
FROM {USAGE_SQL} GROUP BY ALL""")
def q_running_totals(spark, d):
    """Totals of a period and its newest metadata, kept up by batches that
    come in any order, one of them twice; only touched leaves are rewritten."""
    base = _folder(spark)
    u = usage.usage_from_events(T(spark, d, "events")).withColumn(
        "meta", F.from_json("props", "map<string,string>"))
    write = state.totals_writer(base, "daily", "meta", leaf_rows=2000)
    for batch, part in enumerate((2, 0, 0, 1)):
        write(u.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part), min(batch, 1) + batch // 3)
    return state.read_totals(spark, base).select(
        "organization_id", "resource_type",
        F.col("period_start").cast("timestamp_ntz").alias("period_start"),
        F.round("usage", 4).alias("usage"), "records", F.col("metadata")["k"].alias("meta_k"))


@register("late_rows", """
WITH e AS (SELECT event_id, ts, event_id % 4 AS b FROM events),
m AS (SELECT b, max(ts) AS m FROM e GROUP BY b),
w AS (SELECT x.b, (SELECT max(y.m) FROM m y WHERE y.b < x.b) AS seen FROM m x)
SELECT e.b AS batch, coalesce(e.ts < w.seen - INTERVAL 15 DAY, false) AS late, count(*) AS n,
       sum(event_id)::BIGINT AS ids
FROM e JOIN w USING (b) GROUP BY ALL""")
def q_late_rows(spark, d):
    """Rows behind the watermark beside those in time; none is lost."""
    base = _folder(spark)
    e = T(spark, d, "events").select("event_id", "ts")
    write = state.late_split_writer(base, delay_seconds=15 * 86_400)
    for batch in range(4):
        write(e.where(F.col("event_id") % 4 == batch), batch)
    both = [spark.read.parquet(f"{base}/{name}").select(
        F.col("batch_id").cast("long").alias("batch"), F.lit(name == "late").alias("late"),
        "event_id") for name in ("kept", "late")]
    return both[0].unionByName(both[1]).groupBy("batch", "late").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@register("versioned_leaves", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS v FROM orders)
SELECT 0::BIGINT AS version, k, v FROM o WHERE c % 2 = 0
UNION ALL SELECT 1, k, v FROM o
UNION ALL SELECT 2, k, CASE WHEN c % 5 = 0 THEN -v ELSE v END FROM o WHERE c % 7 <> 0""")
def q_versioned_leaves(spark, d):
    """Three merges into a table whose leaves split as it grows; every
    version is read back."""
    path = _folder(spark)
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
                                     F.col("o_totalprice").alias("v"))
    gone = F.col("c") % 7 == 0
    steps = [o.where("c % 2 = 0").withColumn("gone", F.lit(False)),
             o.where("c % 2 <> 0").withColumn("gone", F.lit(False)),
             o.where("c % 5 = 0 OR c % 7 = 0").withColumn("v", -F.col("v")).withColumn("gone", gone)]
    for step in steps:
        versioned.merge(spark, path, step.drop("c"), ["k"], delete_col="gone", leaf_rows=3000)
    return _union([versioned.read(spark, path, v).select(F.lit(v).cast("long").alias("version"),
                                                         "k", "v")
                   for v in versioned.history(spark, path)])


# =========================================================== access

COND_ROLES = [("member", ["events:read:same_org"]), ("owner", ["events:*:owner_only"]),
              ("auditor", ["*:read"])]


@register("access_conditions", """
WITH ev AS (SELECT event_id, user_id, event_id % 3 AS org, CASE WHEN event_id % 4 = 0 THEN NULL
              ELSE event_id % 50 END AS owner, CASE WHEN event_type = 'view' THEN 'read'
              ELSE 'write' END AS action FROM events),
u AS (SELECT DISTINCT user_id, user_id % 3 AS role, user_id % 3 AS uorg,
        CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '2024-01-15 00:00:00'
             WHEN user_id % 5 = 1 THEN TIMESTAMP '2024-02-15 00:00:00' END AS until FROM events)
SELECT action, count(*) AS requests, count_if(
  (until IS NULL OR until > TIMESTAMP '2024-01-31 00:00:00') AND CASE role
    WHEN 0 THEN action = 'read' AND org = uorg
    WHEN 1 THEN owner IS NULL OR owner = ev.user_id
    ELSE action = 'read' END)::BIGINT AS allowed
FROM ev JOIN u USING (user_id) GROUP BY action""")
def q_access_conditions(spark, d):
    """Same-organization and owner-only conditions, expired roles."""
    ev = T(spark, d, "events")
    roles = spark.createDataFrame(COND_ROLES, "role string, permissions array<string>")
    org = lambda c: F.concat(F.lit("org_"), (F.col(c) % 3).cast("string"))
    five = F.col("user_id") % 5
    ur = ev.select("user_id").distinct().select(
        "user_id", F.element_at(F.array(*[F.lit(r) for r, _ in COND_ROLES]),
                                (F.col("user_id") % 3 + 1).cast("int")).alias("role"),
        F.lit(True).alias("is_active"), org("user_id").alias("organization_id"),
        F.when(five == 0, F.lit("2024-01-15")).when(five == 1, F.lit("2024-02-15"))
        .cast("timestamp").alias("expires_at"))
    req = ev.select(F.col("event_id").alias("request_id"), "user_id",
                    F.lit("events").alias("resource"), org("event_id").alias("organization_id"),
                    F.when(F.col("event_type") == "view", "read").otherwise("write")
                    .alias("action"),
                    F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50).alias("owner_id"))
    out = access.check_requests(req, ur, roles, AS_OF)
    return out.groupBy("action").agg(F.count(F.lit(1)).alias("requests"),
                                     F.count_if("allowed").alias("allowed"))


@register("job_dependencies", """
WITH j AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders)
SELECT a.id AS job_id FROM j a WHERE a.s = 'O'
  AND coalesce((SELECT b.s FROM j b WHERE b.id = a.id - 1), 'missing') = 'F'
  AND (a.id % 2 = 1 OR coalesce((SELECT b.s FROM j b WHERE b.id = a.id - 2), 'missing') = 'F')""")
def q_job_dependencies(spark, d):
    """Open orders as pending jobs that wait for the one or two before."""
    o, k = T(spark, d, "orders"), F.col("o_orderkey")
    jobs = o.select(
        k.alias("job_id"), F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.when(k % 2 == 1, F.array(k - 1)).otherwise(F.array(k - 1, k - 2)).alias("depends_on"))
    return lineage.runnable_jobs(jobs).select("job_id")


# =========================================================== runs, metrics, cost

@register("run_minutes", f"""
WITH r AS (SELECT pipeline_id, status, started_at, started_at + (run_id % 90) * INTERVAL 1 MINUTE
             AS completed_at FROM {RUNS_SQL})
SELECT pipeline_id, count(*) AS total_runs, sum(run_minutes)::DOUBLE / count(*) AS avg_minutes FROM (
  SELECT pipeline_id, date_diff('minute', started_at, completed_at) AS run_minutes FROM r)
GROUP BY pipeline_id""")
def q_run_minutes(spark, d):
    """Average minutes of a pipeline's runs."""
    r = runs.runs_from_orders(T(spark, d, "orders")).withColumn(
        "completed_at", F.col("started_at").cast("timestamp") +
        F.make_dt_interval(mins=(F.col("run_id") % 90).cast("int")))
    return runs.pipeline_metrics(r).select("pipeline_id", "total_runs", "avg_minutes")


@register("run_cost", f"""
SELECT pipeline_id, count(*) AS runs, round(sum((run_id % 90) / 60.0 * (run_id % 8 + 1)), 4) AS dbu,
       round(sum((run_id % 90) / 60.0 * (run_id % 8 + 1) * 0.55), 4) AS cost_usd
FROM {RUNS_SQL} GROUP BY pipeline_id""")
def q_run_cost(spark, d):
    """DBU and cost of runs by their nodes and duration."""
    r = runs.runs_from_orders(T(spark, d, "orders")).withColumn(
        "completed_at", F.col("started_at").cast("timestamp") +
        F.make_dt_interval(mins=(F.col("run_id") % 90).cast("int"))) \
        .withColumn("nodes", F.col("run_id") % 8 + 1)
    return usage.run_cost(r).groupBy("pipeline_id").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("dbu"), 4).alias("dbu"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


@register("durations", """
SELECT count(*) AS n, sum(date_diff('millisecond', o_orderdate::TIMESTAMP,
         o_orderdate::TIMESTAMP + (o_orderkey % 7777) * INTERVAL 1 MILLISECOND))::BIGINT AS ms,
       sum((o_orderkey % 7777) // 1000)::BIGINT AS seconds FROM orders""")
def q_durations(spark, d):
    """durations in milliseconds and whole seconds."""
    start = F.date_trunc("SECOND", F.col("o_orderdate").cast("timestamp"))
    end = F.timestamp_millis(F.unix_millis(start) + F.col("o_orderkey") % 7777)
    return T(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("n"), F.sum(periods.duration_ms(start, end)).alias("ms"),
        F.sum(periods.duration_seconds(start, end)).alias("seconds"))


@register("child_counts", """
SELECT o_custkey, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS "F",
       count_if(o_orderstatus = 'O')::BIGINT AS "O" FROM orders GROUP BY o_custkey""")
def q_child_counts(spark, d):
    """Children per parent, by status."""
    return monitoring.status_counts(T(spark, d, "orders"), ["o_custkey"], "o_orderstatus",
                                    ["F", "O"])


@register("metric_series", """
SELECT event_id, ts, value FROM events WHERE event_type = 'purchase'
  AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""")
def q_metric_series(spark, d):
    """One metric's points in an inclusive time range, in order."""
    return monitoring.metric_series(T(spark, d, "events"), "ts", "2024-01-05", "2024-01-20",
                                    "purchase", "event_type").select("event_id", "ts", "value")


@register("not_expired_rows", """
SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 365 DAY END AS until
  FROM orders) WHERE until IS NULL OR until > TIMESTAMP '1998-01-01 00:00:00'""")
def q_not_expired(spark, d):
    """Rows without an expiry or with a later one."""
    o = T(spark, d, "orders").withColumn("expires_at", F.when(
        F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("timestamp") +
        F.expr("INTERVAL 365 DAYS")))
    return o.where(monitoring.not_expired("1998-01-01")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@register("storage_gb", f"""
SELECT organization_id, round(sum(amount) * 1000000 / 1073741824.0, 8) AS gb
FROM {USAGE_SQL} GROUP BY organization_id""")
def q_storage_gb(spark, d):
    """bytes as GB."""
    u = usage.usage_from_events(T(spark, d, "events"))
    return u.groupBy("organization_id").agg(F.round(periods.bytes_to_gb(
        F.round(F.sum("amount"), 2) * 1_000_000), 8).alias("gb"))


# =========================================================== transforms, text, privacy

@register("identity_ingest", """
SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS keys, 'org_1' AS organization,
       'prod' AS environment, true AS stamped FROM nation""")
def q_identity_ingest(spark, d):
    """P5/P10: an empty chain, then the ingest columns."""
    df = transforms.ingest_metadata(transforms.apply_transforms(T(spark, d, "nation"), []),
                                    "org_1", "prod")
    return df.groupBy("organization", "environment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("keys"),
        F.bool_and(F.col("ingestion_timestamp").isNotNull()).alias("stamped"))


@register("cast_errors", """
SELECT count(*) AS n, count_if(try_cast(c AS INT) IS NULL)::BIGINT AS bad,
       sum(try_cast(c AS INT))::BIGINT AS total
FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '' END || (o_orderkey % 1000)::VARCHAR AS c
      FROM orders)""")
def q_cast_errors(spark, d):
    """Casts that list the columns which did not convert."""
    k = F.col("o_orderkey")
    df = T(spark, d, "orders").select(F.concat(
        F.when(k % 9 == 0, "x").otherwise(""), (k % 1000).cast("string")).alias("c"))
    out = transforms.cast_columns(df, {"c": "int"})
    return out.agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(F.size("_cast_errors") > 0).alias("bad"),
                   F.sum(F.col("c").cast("long")).alias("total"))


@register("enrichment", """
SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q_enrichment(spark, d):
    """Lookups joined on by a transform chain."""
    n = T(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                     F.col("n_regionkey").alias("r_regionkey"))
    out = transforms.apply_transforms(T(spark, d, "customer"), [
        {"type": "join", "with": "nation", "on": "c_nationkey"},
        {"type": "join", "with": "region", "on": "r_regionkey"}],
        {"nation": n, "region": T(spark, d, "region")})
    return out.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"),
                                     F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("connection_lookup", """
SELECT c_custkey AS pipeline_id, s.n_name AS source_type, t.n_name AS target_type
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) s ON s.n_nationkey = c_nationkey
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) t ON t.n_nationkey = c_custkey % 30
WHERE c_custkey % 2 = 0""")
def q_connection_lookup(spark, d):
    """Pipelines with the source and target connections of their tenant."""
    c = T(spark, d, "customer").select(
        F.col("c_custkey").alias("pipeline_id"), F.col("c_nationkey").alias("source_connection_id"),
        (F.col("c_custkey") % 30).alias("target_connection_id"),
        F.concat(F.lit("t"), (F.col("c_custkey") % 2).cast("string")).alias("organization_id"))
    con = T(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("connection_type"),
        F.lit("t0").alias("organization_id"), (F.col("n_regionkey") != 2).alias("is_active"))
    return runs.with_connections(c, con, "t0").select("pipeline_id", "source_type", "target_type")


@register("mask_config", """
SELECT count(*) AS n, 0::BIGINT AS leaked, count(*) AS masked, sum(length(s_name))::BIGINT AS kept
FROM supplier""")
def q_mask_config(spark, d):
    """sensitive names masked at the top level, in structs and maps."""
    s = F.col("s_name")
    df = T(spark, d, "supplier").select(
        "s_name", s.alias("db_password"), F.struct(s.alias("api_token"), s.alias("host"))
        .alias("conf"), F.create_map(F.lit("secret"), s, F.lit("port"), s).alias("opts"))
    m = privacy.mask_sensitive(df)
    hidden = [F.col("db_password"), F.col("conf.api_token"), F.col("opts")["secret"]]
    seen = [F.col("conf.host"), F.col("opts")["port"]]
    leak = F.lit(False)
    for h in hidden:
        leak = leak | (h == s)
    for v in seen:
        leak = leak | (v != s)
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(leak).alias("leaked"),
                 F.count_if(hidden[0] == "***").alias("masked"),
                 F.sum(F.length("conf.host")).alias("kept"))


@register("encrypt_round_trip", """
SELECT count(*) AS n, count(c_phone) AS same, 0::BIGINT AS plain,
       sum(length(c_phone))::BIGINT AS chars FROM (
  SELECT CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS c_phone FROM customer)""")
def q_encrypt(spark, d):
    """encrypted fields decrypt to what they were; nulls stay null."""
    df = T(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 6 != 0, F.col("c_name")).alias("v"))
    e = df.withColumn("e", privacy.encrypt(F.col("v"), "0123456789abcdef"))
    back = e.withColumn("b", privacy.decrypt(F.col("e"), "0123456789abcdef"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") == F.col("v")).alias("same"),
                    F.count_if(F.col("e").contains(F.col("v"))).alias("plain"),
                    F.sum(F.length("b")).alias("chars"))


@register("template_text", """
SELECT 'Order ' || o_orderkey || ' of ' || coalesce(nullif(o_orderstatus, 'P'), '') || '.' AS line
FROM orders""")
def q_template(spark, d):
    """placeholders replaced by column values, nulls by nothing."""
    return T(spark, d, "orders").select(render_template(
        "Order {{key}} of {{status}}.", {
            "key": F.col("o_orderkey"),
            "status": F.nullif("o_orderstatus", F.lit("P"))}).alias("line"))


# =========================================================== rules

@register("referential_and_business", "\nUNION ALL ".join([
    rule_sql("ref", "count_if(c_custkey IS NOT NULL)", "count(*)", 1.0,
             "orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) "
             "ON c_custkey = o_custkey", 1.0),
    rule_sql("biz", "count_if(o_totalprice > 1000 AND o_orderstatus <> 'P')", "count(*)", 0.9,
             "orders", 1.0)]))
def q_referential_and_business(spark, d):
    """Q8 and Q10."""
    ref = T(spark, d, "customer").where("c_custkey % 10 <> 0")
    return run_rules(T(spark, d, "orders"), [
        Rule("ref", "consistency", "o_custkey", {"type": "referential", "reference_table": "c",
                                                 "reference_column": "c_custkey"}),
        Rule("biz", "accuracy", None, {"method": "business_rule", "conditions": [
            "o_totalprice > 1000", "o_orderstatus <> 'P'"]})], {"c": ref}).select(*RESULT_COLS)


@register("warning_band", """
WITH r AS (SELECT count(pr)::DOUBLE / count(*) AS rate FROM (
  SELECT nullif(o_orderpriority, '5-LOW') AS pr FROM orders))
SELECT 'warn' AS rule_id, CASE WHEN rate >= 0.95 THEN 'passed' WHEN rate >= 0.5 THEN 'warning'
       ELSE 'failed' END AS status FROM r
UNION ALL SELECT 'fail', CASE WHEN rate >= 0.95 THEN 'passed' WHEN rate >= 0.9 THEN 'warning'
       ELSE 'failed' END FROM r
UNION ALL SELECT 'empty', 'error'""")
def q_warning_band(spark, d):
    """Q21 and Q27: a warning band under the threshold; an empty dataset."""
    o = T(spark, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("pr"))
    rule = lambda i, w: Rule(i, "completeness", "pr", {"warning_threshold": w})
    got = run_rules(o, [rule("warn", 0.5), rule("fail", 0.9)])
    none = run_rules(o.where("pr = 'none'"), [Rule("empty", "completeness", "pr")])
    return got.unionByName(none).select("rule_id", "status")


@register("record_and_schema", """
SELECT 'record:' || CASE WHEN max(o_totalprice) <= 100 THEN 'passed' ELSE 'failed' END AS item,
       1::BIGINT AS n FROM orders
UNION ALL SELECT 'missing:o_gone', 1 UNION ALL SELECT 'extra:o_orderpriority', 1
UNION ALL SELECT 'type_changed:o_custkey', 1""")
def q_record_and_schema(spark, d):
    """The dearest order checked as one record; Q25: schema findings."""
    from pyspark.sql.types import StringType, StructField, StructType

    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).first()
    res = check_record(spark, top.asDict(), [Rule("r", "range_check", "o_totalprice",
                                                  {"max_value": 100})], o.schema)
    want = StructType([f for f in o.schema.fields if f.name in ("o_orderkey", "o_totalprice")] +
                      [StructField("o_custkey", StringType()), StructField("o_gone", StringType())])
    diff = schema_diff(want, o)
    one = F.lit(1).cast("long").alias("n")
    return res.select(F.concat(F.lit("record:"), "status").alias("item"), one).unionByName(
        diff.select(F.concat_ws(":", "issue", "column_name").alias("item"), one))


@register("message_schema", """
SELECT 'OBJECT<k: BIGINT>' AS schema""")
def q_message_schema(spark, d):
    """One merged schema of all event payloads."""
    schema = introspect.infer_message_schema(T(spark, d, "events"), "props")
    return T(spark, d, "events").limit(1).select(F.lit(schema).alias("schema"))


@register("scan_tables", """
SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'
UNION ALL SELECT 'customer', count(*) FROM customer""")
def q_scan_tables(spark, d):
    """Several tables, one of them from its mark on."""
    a = files.scan_tables(spark, d, ["orders"], incremental_column="o_orderdate",
                          last_values={"orders": dt.datetime(1998, 1, 1)})
    b = files.scan_tables(spark, d, ["customer"])
    return _union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n")
                   for k, df in (a | b).items()])


@register("parse_messages", """
SELECT count(*) AS n, count_if(event_id % 11 IN (0, 1))::BIGINT AS corrupt,
       sum(CASE WHEN event_id % 11 NOT IN (0, 1) THEN (props::JSON ->> 'k')::BIGINT END)::BIGINT
         AS total FROM events""")
def q_parse_messages(spark, d):
    """Messages that are no JSON or have a field of another type go
    to the dead letters with their raw text."""
    eleven = F.col("event_id") % 11
    ev = T(spark, d, "events").select(
        F.when(eleven == 0, "{broken").when(eleven == 1, '{"k": "text"}')
        .otherwise(F.col("props")).alias("value"))
    from quarry.sources.external import parse_json_value

    out = parse_json_value(ev, "k long")
    return out.agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(F.col("_corrupt").isNotNull()).alias("corrupt"),
                   F.sum(F.when(F.col("_corrupt").isNull(), F.col("k"))).alias("total"))


# ================================================= incremental profiles

PROFILED = ["l_quantity", "l_extendedprice", "l_partkey"]


@register("profile_incremental", "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count(x) AS null_count,
  avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
  true AS distinct_ok, true AS quantiles_ok
FROM (SELECT nullif({c}, 7)::DOUBLE AS x FROM lineitem)""" for c in PROFILED))
def q_profile_incremental(spark, d):
    """A sketch row per quarter and column, stored by quarter (the last
    ones a second time), merged; distinct counts and quartiles are held against the
    table: within four standard errors, within the rank error."""
    from quarry.operators import sketches

    lines = T(spark, d, "lineitem").select(
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day"),
        *[F.nullif(F.col(c).cast("double"), F.lit(7.0)).alias(c) for c in PROFILED])
    path = _folder(spark)
    sketches.store(lines, path, "day", PROFILED)
    sketches.store(lines.where("day >= DATE'1997-01-01'"), path, "day", PROFILED)
    merged = session.cut_lineage(
        sketches.finish(sketches.merge(sketches.load(spark, path, "day"))))
    kept = merged.select(F.map_from_entries(F.collect_list(F.struct(
        F.col("column_name"), F.struct("q25", "median", "q75"))))).scalar()
    stats = []
    for c in PROFILED:
        x, got = F.col(c), F.element_at(kept, c)
        near = F.lit(True)
        for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
            slack = F.greatest(F.count(x) * sketches.RANK_ERROR, F.lit(1.0))
            near = near & (F.count_if(x < got[name]) - slack <= q * F.count(x)) \
                & (F.count_if(x <= got[name]) + slack >= q * F.count(x))
        stats.append(F.struct(F.lit(c).alias("column_name"), near.alias("quantiles_ok"),
                              F.count_distinct(x).alias("exact")))
    exact = lines.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    close = F.abs(F.col("unique_count") - F.col("exact")) <= F.greatest(
        F.lit(1.0), F.col("exact") * 4 * sketches.DISTINCT_ERROR)
    return merged.join(exact, "column_name").select(
        "column_name", "row_count", "null_count", "mean", "std", "min", "max",
        close.alias("distinct_ok"), "quantiles_ok")


# ================================================= duplicates, outliers, rule selection

@register("outlier_rules", """
WITH x AS (SELECT l_extendedprice * l_extendedprice / 1000000.0::DOUBLE AS v FROM lineitem),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m,
      stddev_samp(v) AS s FROM x),
n AS (SELECT count(*) AS n, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr,
      count(*) FILTER (v < q1 - 0.5 * (q3 - q1) OR v > q3 + 0.5 * (q3 - q1)) AS near,
      count(*) FILTER (abs(v - m) > 3 * s) AS z FROM x, q)
SELECT 'iqr' AS rule_id, iqr AS failed_records, n AS total_records FROM n
UNION ALL SELECT 'iqr_near', near, n FROM n UNION ALL SELECT 'z', z, n FROM n""")
def q_outlier_rules(spark, d):
    """Q11: interquartile ranges and z-scores of one skewed column in one fused run."""
    x = T(spark, d, "lineitem").select(
        (F.col("l_extendedprice") * F.col("l_extendedprice") / F.lit(1000000.0)).alias("v"))
    rules = [Rule("iqr", "accuracy", "v", {"method": "iqr"}),
             Rule("iqr_near", "accuracy", "v", {"method": "iqr", "k": 0.5}),
             Rule("z", "accuracy", "v", {"method": "statistical"})]
    return run_rules(x, rules).select("rule_id", "failed_records", "total_records")


@register("duplicate_rows_all", """
SELECT l_orderkey, l_linenumber, l_partkey, n FROM (SELECT *, count(*) OVER (
  PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) t WHERE n > 1""")
def q_duplicate_rows_all(spark, d):
    """Q26: the rows behind the duplicate keys."""
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return remediate.duplicate_rows(rows, ["l_orderkey", "l_linenumber"])
