"""Tenant usage, quota and cost analytics (A16-A19, G1-G6, G9, X4-X5 batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.periods import period_end_col, period_start_col

USAGE_SCHEMA = "organization_id string, resource_type string, amount double, ts timestamp"

# Default quota templates by compliance level (limits per
# resource type); unknown levels use "medium"; warning at 0.8, monthly reset.
QUOTA_TEMPLATES = {
    "low": {"dbu_hours": 1000, "storage_gb": 1000, "api_calls": 100000,
            "concurrent_pipelines": 10, "databricks_clusters": 5,
            "s3_requests": 1000000, "bandwidth_gb": 100},
    "medium": {"dbu_hours": 5000, "storage_gb": 10000, "api_calls": 500000,
               "concurrent_pipelines": 25, "databricks_clusters": 10,
               "s3_requests": 5000000, "bandwidth_gb": 500},
    "high": {"dbu_hours": 20000, "storage_gb": 100000, "api_calls": 2000000,
             "concurrent_pipelines": 100, "databricks_clusters": 50,
             "s3_requests": 20000000, "bandwidth_gb": 2000},
}
DEFAULT_WARNING = 0.8


def usage_from_events(events: DataFrame, n_orgs: int = 3) -> DataFrame:
    """Usage records derived from ``events``: ``user_id % n`` -> organization,
    ``event_type`` -> resource, ``value`` -> amount."""
    return events.select(
        F.concat(F.lit("org_"), (F.col("user_id") % n_orgs).cast("string"))
        .alias("organization_id"),
        F.col("event_type").alias("resource_type"), F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("props"), F.col("event_id"))


def rollup_batch(usage: DataFrame, metadata_col: str | None = None) -> DataFrame:
    """Per (organization, resource) total amount, record count and the
    merged metadata map (later records win per key).

    The map merge never collects a group: maps are exploded to
    (key, value, ts), the newest value per key is a partial ``max_by``, and
    the map is rebuilt from at most one entry per distinct metadata key.
    """
    keys = ["organization_id", "resource_type"]
    totals = usage.groupBy(*keys).agg(F.sum("amount").alias("total_amount"),
                                      F.count(F.lit(1)).alias("record_count"))
    if not metadata_col:
        return totals
    entries = (usage.select(*keys, "ts", "event_id", F.explode(metadata_col).alias("k", "v"))
               .groupBy(*keys, "k").agg(F.max_by("v", F.struct("ts", "event_id")).alias("v"))
               .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v")))
                                   .alias("metadata")))
    return totals.join(entries, keys, "left")


def usage_per_period(usage: DataFrame, period: str | Column = "monthly") -> DataFrame:
    """Usage accumulated into [period_start, period_end)."""
    p = F.lit(period) if isinstance(period, str) else period
    return (usage.withColumn("period_start", period_start_col(F.col("ts"), p))
            .groupBy("organization_id", "resource_type", "period_start")
            .agg(F.sum("amount").alias("usage"), F.count(F.lit(1)).alias("records"))
            .withColumn("period_end", period_end_col(F.col("period_start"), p)))


def active_quotas(quotas: DataFrame) -> DataFrame:
    """Quotas that are switched on (all, where there is no ``is_active``)."""
    return quotas.where("is_active") if "is_active" in quotas.columns else quotas


def quota_status(quotas: DataFrame, usage: DataFrame, as_of=None) -> DataFrame:
    """Per quota and period, usage / limit (0 when the limit is 0),
    status exceeded (>= 1) / warning (>= warning threshold) / active, and
    the next reset (period end). Usage is bucketed by each quota's own
    ``reset_period``; periods without usage report 0 (left join).

    With ``as_of`` only the period containing ``as_of`` is reported, one row
    per quota; without it, every period that has usage.
    """
    q = active_quotas(quotas).select("organization_id", "resource_type", "quota_limit",
                                     "warning_threshold", "reset_period")
    # Tag every usage row with its quota's period: join on the small quota
    # table (one row per org/resource), then aggregate per period.
    u = usage.join(q.select("organization_id", "resource_type", "reset_period"),
                   ["organization_id", "resource_type"], "inner")
    u = (u.withColumn("period_start", period_start_col(F.col("ts"), F.col("reset_period")))
         .groupBy("organization_id", "resource_type", "period_start")
         .agg(F.sum("amount").alias("current_usage")))
    if as_of is not None:
        t = F.lit(as_of).cast("timestamp")
        base = q.withColumn("period_start", period_start_col(t, F.col("reset_period")))
        out = base.join(u, ["organization_id", "resource_type", "period_start"], "left")
    else:
        out = u.join(q, ["organization_id", "resource_type"], "inner")
    out = out.withColumn("current_usage", F.coalesce("current_usage", F.lit(0.0)))
    pct = F.when(F.col("quota_limit") > 0, F.col("current_usage") / F.col("quota_limit")) \
        .otherwise(F.lit(0.0))
    return (out.withColumn("usage_percentage", pct)
            .withColumn("status", F.when(F.col("usage_percentage") >= 1.0, "exceeded")
                        .when(F.col("usage_percentage") >= F.col("warning_threshold"), "warning")
                        .otherwise("active"))
            .withColumn("next_reset", period_end_col(F.col("period_start"),
                                                     F.col("reset_period"))))


def violations(status: DataFrame) -> DataFrame:
    """G2 + G3: exceeded / warning rows become violations with the action."""
    v = status.where(F.col("status").isin("exceeded", "warning"))
    return v.select("organization_id", "resource_type", "quota_limit",
                    F.col("current_usage").alias("actual_usage"),
                    F.col("status").alias("violation_type"), "period_start",
                    enforcement_action(F.col("status"), F.col("resource_type"))
                    .alias("action_taken"))


def enforcement_action(violation_type: Column, resource_type: Column) -> Column:
    """Exceeded pipelines -> suspend_new_pipelines, exceeded api calls ->
    rate_limit_api, other exceeded -> alert_only, warning -> warning_sent."""
    return (F.when(violation_type == "exceeded",
                   F.when(resource_type == "concurrent_pipelines", "suspend_new_pipelines")
                   .when(resource_type == "api_calls", "rate_limit_api")
                   .otherwise("alert_only"))
            .otherwise("warning_sent"))


def default_quotas(spark: SparkSession, organizations: DataFrame) -> DataFrame:
    """One quota row per organization and resource from its compliance
    level (unknown -> medium). The template table is a fixed 21-row constant
    joined on the level (an equi-join, not a product)."""
    rows = [(lvl, r, float(v)) for lvl, t in QUOTA_TEMPLATES.items() for r, v in t.items()]
    tmpl = spark.createDataFrame(rows, "level string, resource_type string, quota_limit double")
    orgs = organizations.withColumn(
        "level", F.when(F.col("compliance_level").isin(*QUOTA_TEMPLATES), F.col("compliance_level"))
        .otherwise(F.lit("medium")))
    return (orgs.join(F.broadcast(tmpl), "level")
            .select("organization_id", "resource_type", "quota_limit",
                    F.lit(DEFAULT_WARNING).alias("warning_threshold"),
                    F.lit("monthly").alias("reset_period")))


def compliance(snapshot: DataFrame) -> DataFrame:
    """The first violated limit in the order DBU, storage, nodes, budget
    (``None`` = compliant)."""
    checks = [("DBU", "dbu_usage", "max_dbu_per_hour"),
              ("Storage", "storage_gb", "max_storage_gb"),
              ("Compute Nodes", "compute_nodes", "max_compute_nodes"),
              ("Monthly Budget", "cost_this_month", "monthly_budget_usd")]
    v = F.lit(None).cast("string")
    for name, used, limit in reversed(checks):
        v = F.when(F.col(used) >= F.col(limit), F.lit(name)).otherwise(v)
    return snapshot.withColumn("violated", v).withColumn("compliant", v.isNull())


def downsample(metrics: DataFrame, ts: str, value: str, keys: list[str],
               period: str = "1 hour") -> DataFrame:
    """Tumbling-window Sum / Average / Maximum and the latest point
    (of several at that time the largest)."""
    return (metrics.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), period).alias("w"))
            .agg(F.sum(value).alias("sum"), F.avg(value).alias("average"),
                 F.max(value).alias("maximum"), F.count(F.lit(1)).alias("points"),
                 F.max_by(value, F.struct(F.col(ts), F.col(value))).alias("latest"))
            .select(*keys, F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "sum", "average", "maximum",
                    "points", "latest"))


def monthly_cost(costs: DataFrame, org_col: str, ts: str, amount: str,
                 organization: str | None = None) -> DataFrame:
    """Month-to-date sum per organization tag."""
    src = costs if organization is None else costs.where(F.col(org_col) == organization)
    return (src.groupBy(F.col(org_col).alias("organization_id"),
                        F.date_trunc("MONTH", F.col(ts).cast("timestamp")).alias("month"))
            .agg(F.sum(amount).alias("cost"), F.count(F.lit(1)).alias("items")))


BYTES_PER_GB = 1024 ** 3


def usage_snapshot(usage: DataFrame, as_of, dbu_resource: str, storage_resource: str,
                   nodes_resource: str) -> DataFrame:
    """What an organization uses at ``as_of``, from readings before it.

    * ``dbu_usage``: sum of the last hour;
    * ``storage_gb``: a gauge in bytes - the mean of the readings in the last
      clock hour that has any, in GB (never a sum over history);
    * ``compute_nodes``: highest reading of the last five minutes, else 0;
    * ``cost_this_month``: sum of all amounts since the first of the month.
    """
    t = F.lit(as_of).cast("timestamp")
    of = lambda r: F.col("resource_type") == r
    now = usage.where(F.col("ts") < t)
    hours = (now.where(of(storage_resource))
             .groupBy("organization_id", F.date_trunc("HOUR", "ts").alias("hour"))
             .agg(F.avg("amount").alias("mean"))
             .groupBy("organization_id")
             .agg((F.max_by("mean", "hour") / BYTES_PER_GB).alias("storage_gb")))
    sums = now.groupBy("organization_id").agg(
        F.sum(F.when(of(dbu_resource) & (F.col("ts") >= t - F.expr("INTERVAL 1 HOUR")),
                     F.col("amount")).otherwise(0.0)).alias("dbu_usage"),
        F.coalesce(F.max(F.when(of(nodes_resource) & (F.col("ts") >= t - F.expr(
            "INTERVAL 5 MINUTES")), F.col("amount"))), F.lit(0.0)).cast("long")
        .alias("compute_nodes"),
        F.sum(F.when(F.col("ts") >= F.date_trunc("MONTH", t), F.col("amount")).otherwise(0.0))
        .alias("cost_this_month"))
    return sums.join(hours, "organization_id", "left").select(
        "organization_id", "dbu_usage", F.coalesce("storage_gb", F.lit(0.0)).alias("storage_gb"),
        "compute_nodes", "cost_this_month")


def run_cost(runs: DataFrame, dbu_per_node_hour: float = 1.0,
             usd_per_dbu: float = 0.55) -> DataFrame:
    """DBU and cost of each run from its nodes and duration:
    ``runs(run_id, organization_id, nodes, started_at, completed_at)``; an
    unfinished run has none yet."""
    hours = (F.unix_micros(F.col("completed_at").cast("timestamp")) -
             F.unix_micros(F.col("started_at").cast("timestamp"))) / 3_600_000_000
    return runs.withColumn("dbu", F.col("nodes") * hours * dbu_per_node_hour) \
        .withColumn("cost_usd", F.col("dbu") * usd_per_dbu)


def session_totals(usage: DataFrame, idle: str = "1 hour", idle_seconds: int | None = 3600,
                   builtin: bool = False) -> DataFrame:
    """X4 (batch form): a live counter whose expiry is re-armed by every
    increment = a session with an ``idle`` gap per (org, resource); the
    session ends ``idle`` after its last increment.

    By default sessions are cut with the two-level prefix of
    ``sequence.sessionize`` (no (org, resource) sorted whole in one task);
    ``builtin=True`` uses Spark's ``session_window`` instead."""
    keys = ["organization_id", "resource_type"]
    if builtin:
        return (usage.groupBy(*keys, F.session_window("ts", idle).alias("s"))
                .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("increments"))
                .select(*keys, F.col("s.start").alias("session_start"),
                        F.col("s.end").alias("session_end"), "total", "increments"))
    from quarry.operators.sequence import sessionize

    s = sessionize(usage, keys, "ts", idle_seconds)
    return (s.groupBy(*keys, "session_start")
            .agg(F.max(F.col("ts").cast("timestamp")).alias("__last"),
                 F.sum("amount").alias("total"), F.count(F.lit(1)).alias("increments"))
            .select(*keys, "session_start",
                    (F.col("__last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                          F.lit(idle_seconds)))
                    .alias("session_end"), "total", "increments"))
