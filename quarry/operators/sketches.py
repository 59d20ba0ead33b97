"""Incremental column profiles (A9-A12, T4, K11; input of Q24).

A day's rows are scanned once and leave one row per group and column: counts,
moments, bounds and three sketches (HyperLogLog for distinct values, KLL for
quantiles, frequent items for the commonest values). Such rows are merged by
``merge`` for any period, and merged rows merge again, so a profile of a year
reads a few hundred small rows instead of the table. ``profile_columns`` stays
the exact form.

Errors: counts, mean, std, bounds and lengths are exact (up to rounding of
doubles). ``unique_count`` has a relative standard error of
``DISTINCT_ERROR``. A quantile's rank is off by at most ``RANK_ERROR`` of the
non-null rows (with 99 % confidence). A value that more than ``TOP_ERROR`` of the
rows have is always among the frequent items, whose counts are over by at most
that share. The bounds hold for merged rows, however many were merged.

Everything stays inside aggregate functions of the JVM: partial sketches are
made in each task, so a group with a third of all rows shuffles one sketch per
task and column. A group without rows has no row; a column of nulls only has
null statistics and no quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.predicates import is_numeric, is_temporal

HLL_BITS = 14
KLL_K = 800
TOP_TRACKED = 3072          # a frequent-items table of 4 096 slots, 3/4 of them filled
DISTINCT_ERROR = 0.0083     # 1.04 / sqrt(2^HLL_BITS), rounded up
RANK_ERROR = 0.004
TOP_ERROR = 3.5 / 4096

STATISTICS = ("row_count", "non_null", "mean", "m2", "min", "max", "min_length", "max_length",
              "total_length", "min_date", "max_date")


def _hash(col: Column) -> Column:
    return F.when(col.isNotNull(), F.xxhash64(col))


def sketch(df: DataFrame, columns: list[str] | None = None,
           group_by: list[str] | None = None) -> DataFrame:
    """One scan: a row of statistics and sketches per group and column.
    Without ``group_by`` the whole frame is one group."""
    group_by = list(group_by or [])
    columns = columns or [c for c in df.columns if c not in group_by]
    aggs: list[Column] = [F.count(F.lit(1)).alias("__n")]
    structs = []
    for i, name in enumerate(columns):
        col, kind = F.col(f"`{name}`"), df.schema[name].dataType
        number = col.cast("double") if is_numeric(kind) else F.lit(None).cast("double")
        number = F.when(~F.isnan(number), number)
        text = col if kind.typeName() == "string" else F.lit(None).cast("string")
        date = col.cast("timestamp") if is_temporal(kind) else F.lit(None).cast("timestamp")
        parts = {
            "non_null": F.count(col), "numbers": F.count(number), "mean": F.avg(number),
            "variance": F.var_pop(number), "min": F.min(number), "max": F.max(number),
            "min_length": F.min(F.length(text)).cast("bigint"),
            "max_length": F.max(F.length(text)).cast("bigint"),
            "total_length": F.sum(F.length(text)).cast("bigint"),
            "min_date": F.min(date), "max_date": F.max(date),
            "distinct": F.hll_sketch_agg(_hash(col), HLL_BITS),
            "quantiles": F.kll_sketch_agg_double(number, F.lit(KLL_K)),
            "top": F.call_function("approx_top_k_accumulate", text, F.lit(TOP_TRACKED))}
        aggs += [e.alias(f"{k}{i}") for k, e in parts.items()]
        get = {k: F.col(f"{k}{i}") for k in parts}
        get["m2"] = get.pop("variance") * get["numbers"]
        structs.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(kind.simpleString()).alias("data_type"),
            F.col("__n").alias("row_count"), *[e.alias(k) for k, e in get.items()]))
    row = df.groupBy(*group_by).agg(*aggs)
    return row.where("__n > 0").select(*group_by, F.explode(F.array(*structs)).alias("__p")) \
        .select(*group_by, "__p.*")


def merge(sketches: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Rows of ``sketch`` or ``merge`` of one column and group as one row. Second
    moments are merged around the joint mean, not as differences of large sums."""
    keys = [*(group_by or []), "column_name", "data_type"]
    joint = sketches.groupBy(*keys).agg(
        (F.sum(F.col("mean") * F.col("numbers")) / F.nullif(F.sum("numbers"), F.lit(0)))
        .alias("__mean"))
    own = joint.select(*[F.col(k).alias(f"__{k}") for k in keys], "__mean")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    spread = F.col("m2") + F.col("numbers") * F.pow(F.col("mean") - F.col("__mean"), F.lit(2))
    return sketches.join(own, same).groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null").alias("non_null"),
        F.sum("numbers").alias("numbers"), F.first("__mean").alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
        F.sum("total_length").alias("total_length"), F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("top"), F.lit(TOP_TRACKED)).alias("top"),
        F.sum(spread).alias("m2"))


def finish(merged: DataFrame, top: int = 5) -> DataFrame:
    """Profile columns as ``profile_columns`` names them, and the ``top``
    commonest texts as ``top_values`` (array of item and count)."""
    n = F.col("row_count")
    std = F.when(F.col("numbers") > 1, F.sqrt(F.col("m2") / (F.col("numbers") - 1)))

    def quantile(q: float) -> Column:
        # an empty sketch has no quantile: it must not be asked
        return F.when(F.col("numbers") > 0,
                      F.kll_sketch_get_quantile_double("quantiles", F.lit(q)))

    keys = [c for c in merged.columns if c not in
            {*STATISTICS, "numbers", "distinct", "quantiles", "top"}]
    unique = F.hll_sketch_estimate("distinct")
    return merged.select(
        *keys, "row_count", (n - F.col("non_null")).alias("null_count"),
        ((n - F.col("non_null")) * 100.0 / n).alias("null_percentage"),
        unique.alias("unique_count"), (unique * 100.0 / n).alias("unique_percentage"),
        "mean", std.alias("std"), "min", "max", quantile(.25).alias("q25"),
        quantile(.5).alias("median"), quantile(.75).alias("q75"), "min_length", "max_length",
        (F.col("total_length") / F.nullif(F.col("non_null"), F.lit(0))).alias("avg_length"),
        "min_date", "max_date",
        F.floor((F.unix_micros("max_date") - F.unix_micros("min_date"))
                / F.lit(86_400_000_000)).cast("bigint").alias("date_range_days"),
        # null is tracked as an item of its own
        F.slice(F.filter(F.call_function("approx_top_k_estimate", F.col("top"), F.lit(top + 1)),
                         lambda t: t["item"].isNotNull()), 1, top).alias("top_values"))


def store(df: DataFrame, path: str, day: str, columns: list[str] | None = None,
          group_by: list[str] | None = None) -> None:
    """Add the sketches of the days that ``df`` holds (column ``day``) to the
    folder ``path``, a partition per day. Days that are there already are replaced,
    so a repeated run counts no row twice; other days are not touched or read.
    ``df`` has to hold its days whole."""
    columns = columns or [c for c in df.columns if c not in {day, *(group_by or [])}]
    sketch(df, columns, [*(group_by or []), day]).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def load(spark: SparkSession, path: str, day: str, start=None, end=None) -> DataFrame:
    """Stored sketches of the days from ``start`` up to and without ``end``: a filter on
    the partition column, so other days' files aren't opened."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where(F.col(day) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(day) < F.lit(end))
    return rows


def metric_series(sketches: DataFrame, group_by: list[str], day: str) -> DataFrame:
    """Q24's input from stored sketches: ``key`` (group, column and metric), the day and
    the metric's value, for ``monitoring.anomalies``. No sketch is opened but for the
    distinct counts."""
    n, some = F.col("row_count"), F.col("non_null")
    metrics = {"row_count": n, "null_percentage": (n - some) * 100.0 / n, "mean": F.col("mean"),
               "unique_count": F.hll_sketch_estimate("distinct")}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
                      for k, v in metrics.items()])
    group = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group_by]
    return sketches.select(*group_by, "column_name", day, F.explode(pairs).alias("m"), *[
        g.alias(f"__g{i}") for i, g in enumerate(group)]).where("m.value IS NOT NULL").select(
        F.to_json(F.array(*[F.col(f"__g{i}") for i in range(len(group))], F.col("column_name"),
                          F.col("m.metric"))).alias("key"),
        *group_by, "column_name", "m.metric", F.col(day).alias("day"), "m.value")
