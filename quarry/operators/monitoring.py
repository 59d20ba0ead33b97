"""Alerts, health and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Health status ranks (worst is highest); "unknown" is ignored.
HEALTH_RANK = {"healthy": 0, "degraded": 1, "unhealthy": 2}


def upsert_alerts(alerts: DataFrame, keys=("name", "service", "organization_id"),
                  ts: str = "created_at", id_col: str = "alert_id") -> DataFrame:
    """While an alert with the same key is active the existing row is
    updated in place: the id of the first alert stays, message/details and
    created_at come from the newest. Partial ``min_by``/``max_by`` per key.
    Alerts that are closed (``is_active`` false) stay as they are and lend
    nothing to a later alert of their key."""
    keys = list(keys)
    newest = F.struct(F.col(ts), F.col(id_col))
    if "is_active" in alerts.columns:
        active = F.coalesce("is_active", F.lit(True))
        closed = alerts.where(~active).select(
            *keys, id_col, "message", "details", ts, F.lit(1).cast("long").alias("occurrences"),
            F.lit(False).alias("is_active"))
        open_ = upsert_alerts(alerts.where(active).drop("is_active"), keys, ts, id_col)
        return open_.withColumn("is_active", F.lit(True)).unionByName(closed)
    return (alerts.groupBy(*keys)
            .agg(F.min_by(id_col, newest).alias(id_col),
                 F.max_by(F.struct("message", "details"), newest).alias("__n"),
                 F.max(ts).alias(ts), F.count(F.lit(1)).alias("occurrences"))
            .select(*keys, id_col, "__n.message", "__n.details", ts, "occurrences"))


def health_rollup(results: DataFrame, services: DataFrame,
                  group: list[str] | None = None) -> DataFrame:
    """Overall status per group: any critical service unhealthy ->
    unhealthy, else any critical degraded -> degraded, else healthy.
    Services missing from ``services`` count as critical; ``unknown`` and
    non-critical services never change the outcome; no rows -> healthy."""
    group = group or []
    r = results.join(services.select("service_name", "critical"), "service_name", "left")
    rank = F.create_map(*[F.lit(x) for kv in HEALTH_RANK.items() for x in kv])
    crit = F.coalesce(F.col("critical"), F.lit(True))
    worst = F.max(F.when(crit, rank[F.col("status")]))
    inv = {v: k for k, v in HEALTH_RANK.items()}
    agg = r.groupBy(*group).agg(worst.alias("__w"), F.count(F.lit(1)).alias("services"))
    return agg.select(*group, "services",
                      F.coalesce(F.create_map(*[F.lit(x) for kv in inv.items() for x in kv])
                                 [F.col("__w")], F.lit("healthy")).alias("overall_status"))


def score_trend(scores: DataFrame, key: str, day: str, score: str,
                window_days: int = 7) -> DataFrame:
    """Day-over-day change and trailing moving average of a daily score.
    The input is one row per (key, day) - already aggregated - so each
    window partition is bounded by the number of days."""
    w = Window.partitionBy(key).orderBy(day)
    return (scores.withColumn("previous", F.lag(score).over(w))
            .withColumn("change", F.col(score) - F.col("previous"))
            .withColumn("moving_avg", F.avg(score).over(w.rowsBetween(-(window_days - 1), 0))))


def anomalies(scores: DataFrame, key: str, day: str, score: str, window_days: int = 7,
              z: float = 3.0) -> DataFrame:
    """Q24: a daily value is anomalous when it is more than ``z`` trailing
    standard deviations away from the trailing mean (previous days only)."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-window_days, -1)
    return (scores.withColumn("trail_mean", F.avg(score).over(w))
            .withColumn("trail_std", F.stddev_samp(score).over(w))
            .withColumn("is_anomaly", F.coalesce(
                F.abs(F.col(score) - F.col("trail_mean")) > F.lit(z) * F.col("trail_std"),
                F.lit(False))))


def status_counts(df: DataFrame, group: list[str], status: str, values: list[str]) -> DataFrame:
    """Conditional counts per group."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == v).alias(v) for v in values])


def quality_report(results: DataFrame, period: str = "daily", start=None, end=None,
                   datasets: list[str] | None = None) -> DataFrame:
    """Per period (daily/weekly/monthly) and dataset the total
    (errors included), the count of each status and the score = passed /
    total, as ``overall_score`` has it."""
    unit = {"daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}[period]
    r = results
    if start is not None:
        r = r.where(F.col("executed_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        r = r.where(F.col("executed_at") <= F.lit(end).cast("timestamp"))
    if datasets:
        r = r.where(F.col("dataset_name").isin(datasets))
    return (r.groupBy(F.date_trunc(unit, "executed_at").alias("period_start"), "dataset_name")
            .agg(F.count(F.lit(1)).alias("total_rules"),
                 F.count_if(F.col("status") == "passed").alias("passed"),
                 F.count_if(F.col("status") == "failed").alias("failed"),
                 F.count_if(F.col("status") == "warning").alias("warning"),
                 F.count_if(F.col("status") == "error").alias("errors"))
            .withColumn("score", F.col("passed") / F.col("total_rules")))


def overall_score(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Passed / total rules per check; no rules -> 1.0."""
    g = group or []
    return (results.groupBy(*g)
            .agg(F.count(F.lit(1)).alias("total_rules"),
                 F.count_if(F.col("status") == "passed").alias("passed_rules"))
            .withColumn("overall_score", F.coalesce(
                F.col("passed_rules") / F.nullif(F.col("total_rules"), F.lit(0)), F.lit(1.0))))


def time_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Inclusive ``start <= ts <= end``."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"),
                                      F.lit(end).cast("timestamp")))


# Request paths that are never audited.
AUDIT_EXCLUDED_PATHS = ("/health", "/metrics", "/docs", "/openapi.json")


def audit_rows(requests: DataFrame) -> DataFrame:
    """Request log -> audit rows (api_request on api_endpoint), excluded
    paths dropped, severity low, new_values map, first forwarded IP."""
    from quarry.functions.text import first_forwarded_ip

    return (requests.where(~F.col("path").isin(*AUDIT_EXCLUDED_PATHS))
            .select("user_id", "tenant_id", F.lit("api_request").alias("action"),
                    F.lit("api_endpoint").alias("resource_type"),
                    F.concat_ws(" ", "method", "path").alias("description"),
                    F.create_map(F.lit("method"), F.col("method"), F.lit("path"), F.col("path"),
                                 F.lit("status_code"), F.col("status_code").cast("string"),
                                 F.lit("duration_ms"), F.col("duration_ms").cast("string"))
                    .alias("new_values"),
                    first_forwarded_ip(F.col("forwarded_for")).alias("ip_address"),
                    F.lit("low").alias("severity"), "ts"))


def retention_purge(df: DataFrame, as_of, column: str = "retention_until") -> DataFrame:
    """Keep rows whose retention has not expired (NULL = keep)."""
    return df.where(not_expired(as_of, column))


def not_expired(as_of, column: str = "expires_at") -> Column:
    """No expiry, or one after ``as_of``."""
    return F.col(column).isNull() | (F.col(column) > F.lit(as_of).cast("timestamp"))


def search_reports(reports: DataFrame, dataset: str | None = None, start=None, end=None,
                   limit: int = 100) -> DataFrame:
    """Quality reports filtered by dataset and dates, newest first."""
    r = reports
    if dataset is not None:
        r = r.where(F.col("dataset_name") == dataset)
    if start is not None:
        r = r.where(F.col("executed_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        r = r.where(F.col("executed_at") <= F.lit(end).cast("timestamp"))
    return r.orderBy(F.col("executed_at").desc(), F.col("rule_id")).limit(limit)


def metric_series(metrics: DataFrame, ts: str, start=None, end=None,
                  name: str | None = None, name_col: str = "metric_name") -> DataFrame:
    """One metric's points in an inclusive time range, time-ordered."""
    m = metrics if name is None else metrics.where(F.col(name_col) == name)
    if start is not None and end is not None:
        m = time_range(m, ts, start, end)
    return m.orderBy(F.col(ts).asc())
