"""Pipeline run analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import latest_per_key

# Order status letter -> run status; run timeout in seconds.
STATUS_MAP = {"F": "success", "O": "running", "P": "failed"}
RUN_TIMEOUT_SECONDS = 3600

# Sortable fields for listings (T7 whitelist).
SORTABLE = ("started_at", "run_id", "pipeline_id", "status", "records_processed")


def runs_from_orders(orders: DataFrame) -> DataFrame:
    """Runs derived from ``orders``: customer -> pipeline, order -> run,
    order date -> started_at, status F/O/P -> success/running/failed."""
    status = F.create_map(*[F.lit(x) for kv in STATUS_MAP.items() for x in kv])
    return orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("pipeline_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        status[F.col("o_orderstatus")].alias("status"),
        F.col("o_totalprice").alias("records_processed"),
        F.col("o_orderpriority").alias("priority"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Last run per pipeline by (started_at desc, run_id desc)."""
    return latest_per_key(runs, ["pipeline_id"], [F.col("started_at"), F.col("run_id")])


def pipeline_metrics(runs: DataFrame) -> DataFrame:
    """Total / success / failed runs, average records and (of finished
    runs with a ``completed_at``) average minutes per pipeline."""
    minutes = F.lit(None).cast("double")
    if "completed_at" in runs.columns:
        minutes = (F.unix_micros(F.col("completed_at").cast("timestamp")) -
                   F.unix_micros(F.col("started_at").cast("timestamp"))) / 60_000_000
    return (runs.groupBy("pipeline_id")
            .agg(F.count(F.lit(1)).alias("total_runs"),
                 F.count_if(F.col("status") == "success").alias("successful_runs"),
                 F.count_if(F.col("status") == "failed").alias("failed_runs"),
                 F.avg("records_processed").alias("avg_records"),
                 F.avg(minutes).alias("avg_minutes")))


def classify_timeouts(runs: DataFrame, as_of,
                      limit_seconds: int = RUN_TIMEOUT_SECONDS) -> DataFrame:
    """A running run older than the limit at ``as_of`` is a timeout."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("started_at"))
    return runs.withColumn("status", F.when((F.col("status") == "running") &
                                            (age > limit_seconds), "timeout")
                           .otherwise(F.col("status")))


def page(df: DataFrame, sort_by: str = "started_at", descending: bool = True,
         tiebreak: str = "run_id", offset: int = 0, limit: int = 100) -> DataFrame:
    """Ordered page; only whitelisted fields, id tiebreak."""
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by}")
    o = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    t = F.col(tiebreak).desc() if descending else F.col(tiebreak).asc()
    out = df.orderBy(o, t)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def pipeline_list(pipelines: DataFrame, runs: DataFrame, status: str | None = None,
                  search: Column | None = None, versions: DataFrame | None = None) -> DataFrame:
    """Pipelines (optionally filtered) with their last run and, when a
    versions table is given, their current version attached."""
    p = pipelines
    if status is not None:
        p = p.where(F.col("status") == status)
    if search is not None:
        p = p.where(search)
    last = latest_run(runs).select("pipeline_id", F.col("run_id").alias("last_run_id"),
                                   F.col("started_at").alias("last_run_at"),
                                   F.col("status").alias("last_run_status"))
    out = p.join(last, "pipeline_id", "left")
    if versions is not None:
        cur = current_version(versions).select(
            "pipeline_id", F.col("version").alias("current_version"))
        out = out.join(cur, "pipeline_id", "left")
    return out


def current_version(versions: DataFrame) -> DataFrame:
    """The current version per pipeline - the flagged one, newest first
    when several are flagged."""
    return latest_per_key(versions.where(F.col("is_current")), ["pipeline_id"],
                          [F.col("created_at"), F.col("version")])


def observed_metrics(df: DataFrame, name: str = "run_metrics") -> DataFrame:
    """Records / bytes counted while the data is written - no extra scan.
    Read the values from the ``Observation`` after the action."""
    return df.observe(name, F.count(F.lit(1)).alias("records_processed"))


def with_connections(pipelines: DataFrame, connections: DataFrame, tenant: str) -> DataFrame:
    """Pipeline -> source and target connection rows of the same tenant."""
    c = connections.where((F.col("organization_id") == tenant) & F.col("is_active"))
    src = c.select(F.col("id").alias("source_connection_id"),
                   F.col("connection_type").alias("source_type"))
    tgt = c.select(F.col("id").alias("target_connection_id"),
                   F.col("connection_type").alias("target_type"))
    p = pipelines.where(F.col("organization_id") == tenant)
    return (p.join(src, "source_connection_id", "left")
            .join(tgt, "target_connection_id", "left"))


def soft_delete(pipelines: DataFrame, runs: DataFrame, ids: DataFrame) -> DataFrame:
    """P20: archive the pipelines listed in ``ids(pipeline_id)``: set
    ``is_active = false`` and ``status = 'archived'`` unless the pipeline has
    a pending or running run (then it is left unchanged and ``refused``).
    Returns the rewritten pipelines table (to be written as a new version)."""
    busy = (runs.where(F.col("status").isin("pending", "running"))
            .select("pipeline_id").distinct().withColumn("__busy", F.lit(True)))
    asked = ids.select("pipeline_id").distinct().withColumn("__asked", F.lit(True))
    p = pipelines.join(asked, "pipeline_id", "left").join(busy, "pipeline_id", "left")
    asked_c = F.coalesce(F.col("__asked"), F.lit(False))
    busy_c = F.coalesce(F.col("__busy"), F.lit(False))
    archive = asked_c & ~busy_c
    return (p.withColumn("is_active", F.when(archive, F.lit(False)).otherwise(F.col("is_active")))
            .withColumn("status", F.when(archive, F.lit("archived")).otherwise(F.col("status")))
            .withColumn("refused", asked_c & busy_c)
            .drop("__asked", "__busy"))
