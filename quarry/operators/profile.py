"""Column profiling.

One aggregate pass computes every column's statistics; the single result
row is turned into one row per column with ``explode`` (no per-column scan,
nothing collected).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.predicates import is_numeric, is_temporal
from quarry.operators.topk import tree_top

PROFILE_SCHEMA = [
    ("column_name", "string"), ("data_type", "string"), ("null_count", "bigint"),
    ("null_percentage", "double"), ("unique_count", "bigint"), ("unique_percentage", "double"),
    ("mean", "double"), ("median", "double"), ("std", "double"), ("min", "double"),
    ("max", "double"), ("q25", "double"), ("q75", "double"),
    ("min_length", "bigint"), ("max_length", "bigint"), ("avg_length", "double"),
    ("min_date", "timestamp"), ("max_date", "timestamp"), ("date_range_days", "bigint"),
]


# Exact distinct counts expand each row once per column: so many at a time.
DISTINCT_PER_PASS = 4


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def profile_columns(df: DataFrame, columns: list[str] | None = None,
                    quantiles: str = "exact", accuracy: int = 10000,
                    approx_distinct: bool = False) -> DataFrame:
    """Base, numeric, string and date statistics per column.

    Quantiles follow pandas' linear interpolation. ``quantiles="exact"``
    selects them with ``exact_quantiles`` (a few bounded passes, no column
    held in one task); ``"percentile"`` uses Spark's in-memory exact
    ``percentile`` (one pass, but a value->count map per column in one
    task); ``"approx"`` uses ``percentile_approx``. ``approx_distinct``
    switches the unique count to HyperLogLog.
    """
    cols = columns or df.columns
    # Exact distinct counts expand the input once per column (Expand); any
    # other aggregate sharing that pass is evaluated on the expanded rows.
    # So distinct counts get passes of their own, a few columns each (all at once
    # where they are approximate), and are joined back per column
    # (an equi-join of two tiny per-column frames).
    aggs: list[Column] = [F.count(F.lit(1)).alias("__n")]
    uniq: list[Column] = []
    for i, c in enumerate(cols):
        col, dt = F.col(f"`{c}`"), df.schema[c].dataType
        aggs.append(F.count(col).alias(f"nn{i}"))
        uniq.append(F.struct(F.lit(c).alias("column_name"),
                             (F.approx_count_distinct(col) if approx_distinct
                              else F.count_distinct(col)).alias("unique_count")))
        if is_numeric(dt):
            x = col.cast("double")
            aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
            if quantiles == "percentile":
                aggs.append(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
                            .alias(f"q{i}"))
            elif quantiles == "approx":
                aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"q{i}"))
        elif isinstance(dt, StringType):
            ln = F.length(col)
            aggs += [F.min(ln).alias(f"minl{i}"), F.max(ln).alias(f"maxl{i}"),
                     F.avg(ln).alias(f"avgl{i}")]
        elif is_temporal(dt):
            ts = col.cast("timestamp")
            aggs += [F.min(ts).alias(f"mind{i}"), F.max(ts).alias(f"maxd{i}")]
    row = df.agg(*aggs)
    some = len(uniq) if approx_distinct else DISTINCT_PER_PASS
    passes = [df.agg(F.array(*uniq[at:at + some]).alias("u")).select(F.explode("u").alias("u"))
              for at in range(0, len(uniq), some)]
    uniques = functools.reduce(DataFrame.unionByName, passes).select("u.*")
    n = F.col("__n")
    structs = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        nn = F.col(f"nn{i}")
        f = {"column_name": F.lit(c), "data_type": F.lit(dt.simpleString()),
             "null_count": n - nn,
             "null_percentage": F.when(n > 0, (n - nn) * 100.0 / n),
             "__n": n}
        if is_numeric(dt):
            f.update({"mean": F.col(f"mean{i}"), "std": F.col(f"std{i}"),
                      "min": F.col(f"min{i}"), "max": F.col(f"max{i}")})
            if quantiles != "exact":
                f.update({"median": F.col(f"q{i}")[1], "q25": F.col(f"q{i}")[0],
                          "q75": F.col(f"q{i}")[2]})
        elif isinstance(dt, StringType):
            f.update({"min_length": F.col(f"minl{i}"), "max_length": F.col(f"maxl{i}"),
                      "avg_length": F.col(f"avgl{i}")})
        elif is_temporal(dt):
            lo, hi = F.col(f"mind{i}"), F.col(f"maxd{i}")
            f.update({"min_date": lo, "max_date": hi,
                      "date_range_days": F.floor((F.unix_micros(hi) - F.unix_micros(lo))
                                                 / F.lit(86_400_000_000)).cast("bigint")})
        fields = [(f[k] if k in f else _null(t)).cast(t).alias(k) for k, t in PROFILE_SCHEMA
                  if k not in ("unique_count", "unique_percentage")]
        structs.append(F.struct(*fields, n.alias("__n")))
    stats = row.select(F.explode(F.array(*structs)).alias("p")).select("p.*")
    numeric = [c for c in cols if is_numeric(df.schema[c].dataType)]
    if quantiles == "exact" and numeric:
        qv = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
        wide = qv.groupBy("column_name").agg(
            *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n)
              for q, n in ((0.25, "__q25"), (0.5, "__median"), (0.75, "__q75"))])
        stats = (stats.join(wide, "column_name", "left")
                 .withColumn("q25", F.col("__q25")).withColumn("median", F.col("__median"))
                 .withColumn("q75", F.col("__q75")).drop("__q25", "__median", "__q75"))
    out = stats.join(uniques, "column_name")
    out = out.withColumn("unique_percentage",
                         F.when(F.col("__n") > 0, F.col("unique_count") * 100.0 / F.col("__n"))
                         .otherwise(F.lit(0.0)))
    return out.select(*[F.col(k).cast(t).alias(k) for k, t in PROFILE_SCHEMA])


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Most common non-null values (count desc, value asc as
    tiebreak). The group-by is partially aggregated; the top-k is a
    per-partition top-k merged once (TakeOrderedAndProject)."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("value").asc())
            .limit(k))


def top_values_all(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """A11 for several columns in one pass: the columns are unpivoted to
    (column, value) and counted per pair (partial aggregation); the counts are
    ranked by ``tree_top``, so a high-cardinality column is never ranked whole
    in one task."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    return tree_top(counts, ["column_name"], [F.col("count").desc(), F.col("value")], k, "rank") \
        .select("column_name", "value", "count", "rank")


def table_statistics(df: DataFrame, partition_columns: list[str] | None = None,
                     columns: list[str] | None = None) -> DataFrame:
    """One row with the row count, the number of partitions (distinct
    values of the partition columns; 1 without any) and per column the null
    and distinct counts, minimum and maximum (as text). Distinct counts run
    in passes of their own, a few columns at a time, so that they don't
    multiply the rows of the other aggregates."""
    columns = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggs += [F.count_if(col.isNull()).alias(f"n{i}"),
                 F.min(col).cast("string").alias(f"lo{i}"),
                 F.max(col).cast("string").alias(f"hi{i}")]
    out, distinct = df.agg(*aggs), {}
    for at in range(0, len(columns), DISTINCT_PER_PASS):
        some = range(at, min(at + DISTINCT_PER_PASS, len(columns)))
        one = df.select(F.struct(*[F.count_distinct(F.col(f"`{columns[i]}`")).alias(f"d{i}")
                                   for i in some])).scalar()
        distinct |= {i: one[f"d{i}"] for i in some}
    parts = df.select(*partition_columns).distinct().select(F.count(F.lit(1))).scalar() \
        if partition_columns else F.lit(1).cast("long")
    stats = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.struct(
        F.col(f"n{i}").alias("null_count"), distinct[i].alias("distinct_count"),
        F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")))
        for i, c in enumerate(columns)]))
    return out.select("row_count", parts.alias("partition_count"), stats.alias("column_stats"))


def table_files(df: DataFrame) -> DataFrame:
    """File-level facts from the scan's ``_metadata`` (size in bytes,
    file count, last modification). Only the metadata columns are read."""
    files = (df.select(F.col("_metadata.file_path").alias("f"),
                       F.col("_metadata.file_size").alias("s"),
                       F.col("_metadata.file_modification_time").alias("m"))
             .groupBy("f").agg(F.max("s").alias("s"), F.max("m").alias("m")))
    return files.agg(F.sum("s").alias("size_bytes"), F.count(F.lit(1)).alias("file_count"),
                     F.max("m").alias("last_updated"))


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float],
                    accuracy: int = 20_000, grid: int = 1000,
                    max_candidates: int = 100_000) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas / SQL ``quantile_cont``)
    of numeric columns without holding a column in one task.

    The order statistics ``x(r0)``, ``x(r1)`` (``r0 = floor(q (n-1))``,
    ``r1 = ceil(q (n-1))``) are narrowed down in rounds. One global
    aggregate pass per round gives, per column and quantile, the exact number
    of values below and inside the current value range plus an approximate
    quantile grid (``percentile_approx``, ``grid + 1`` points) of the values
    inside; the next range is the pair of grid points bracketing the target
    ranks (rank error 1/accuracy < 1/grid; the next round's exact counts
    confirm the pair, and one that lost its rank is drawn again four times as
    wide). Each round shrinks the range by about ``grid / 3`` (two rounds for
    10^10 values), as many rounds as it takes; once at most
    ``max_candidates`` values remain they
    are ranked in one small window per column and quantile. Ranges are
    literal predicates, so rows outside every range are dropped by the
    codegen'd filter; between rounds a few numbers per (column, quantile)
    reach the driver. Returns ``(column_name, q, value)``."""
    from pyspark.sql import Window

    spark = df.sparkSession
    fractions = F.lit([i / grid for i in range(grid + 1)])   # one array literal
    keys = [(c, q) for c in columns for q in qs]
    state = {k: {"lo": None, "hi": None, "below": 0, "margin": 1, "last": None} for k in keys}

    def xcol(c: str) -> Column:
        return F.col(f"`{c}`").cast("double")

    def in_range(c: str, lo, hi) -> Column:
        cond = xcol(c).isNotNull()
        if lo is not None:
            cond = cond & (xcol(c) >= F.lit(lo))
        if hi is not None:
            cond = cond & (xcol(c) <= F.lit(hi))
        return cond

    prev = {k: (None, None) for k in keys}     # range the rows of this round come from
    rnd = -1
    while True:
        rnd += 1
        # rows outside every previous range cannot matter any more: below-counts
        # only grow by values inside the previous range
        src = df
        if rnd > 0:
            keep = F.lit(False)
            for c, lo, hi in {(c,) + prev[(c, q)] for c, q in keys}:
                keep = keep | in_range(c, lo, hi)
            src = df.where(keep)
        # one set of aggregates per distinct (column, previous range, range):
        # in the first round all quantiles of a column share it
        combos = sorted({(c,) + prev[(c, q)] + (state[(c, q)]["lo"], state[(c, q)]["hi"])
                         for c, q in keys}, key=repr)
        aggs = []
        for i, (c, plo, phi, lo, hi) in enumerate(combos):
            x = xcol(c)
            newly_below = in_range(c, plo, phi) & (x < F.lit(lo)) if lo is not None \
                else F.lit(False)
            aggs += [F.count_if(newly_below).alias(f"b{i}"),
                     F.count_if(in_range(c, lo, hi)).alias(f"m{i}"),
                     F.percentile_approx(F.when(in_range(c, lo, hi), x), fractions, accuracy)
                     .alias(f"g{i}")]
        row = src.agg(*aggs).first()
        wide = False
        for key in keys:
            v = state[key]
            i = combos.index((key[0],) + prev[key] + (v["lo"], v["hi"]))
            b, m, g = row[f"b{i}"], row[f"m{i}"], row[f"g{i}"]
            if rnd == 0:
                pos = key[1] * (m - 1)
                v.update(pos=pos, r0=int(pos // 1), r1=int(-(-pos // 1)))
            v["below"] += b
            v["m"] = m
            if m and not (v["below"] <= v["r0"] and v["r1"] < v["below"] + m):
                # draw the range again from the round before, wider
                v.update(v["last"], margin=v["margin"] * 4)
                m, g = v["m"], v["g"]
            else:
                v["last"] = {"lo": v["lo"], "hi": v["hi"], "below": v["below"], "m": m, "g": g}
            prev[key] = (v["lo"], v["hi"])
            done = v.get("done") or m <= max_candidates or (
                v["lo"] is not None and v["lo"] == v["hi"])
            if not done:
                f0 = (v["r0"] - v["below"]) / (m - 1)
                f1 = (v["r1"] - v["below"]) / (m - 1)
                i0 = max(0, int(f0 * grid) - v["margin"])
                i1 = min(grid, int(-(-f1 * grid // 1)) + v["margin"])
                new = (g[i0] if i0 > 0 else v["lo"], g[i1] if i1 < grid else v["hi"])
                if new == (v["lo"], v["hi"]):
                    done = True       # heavy ties: few distinct values remain
                else:
                    v["lo"], v["hi"] = new
                    wide = True
            v["done"] = done
        if not wide:
            break
    live = [k for k in keys if state[k]["m"]]
    if not live:
        return spark.createDataFrame([], "column_name string, q double, value double")
    # final: the remaining candidates of each (column, quantile), counted per
    # distinct value; the running count over distinct values locates the two
    # order statistics (ties cost one row each)
    keep = F.lit(False)
    for c, q in live:
        keep = keep | in_range(c, state[(c, q)]["lo"], state[(c, q)]["hi"])
    cand = df.where(keep).select(F.explode(F.array(*[
        F.when(in_range(c, state[(c, q)]["lo"], state[(c, q)]["hi"]),
               F.struct(F.lit(c).alias("column_name"), F.lit(q).alias("q"),
                        xcol(c).alias("x")))
        for c, q in live])).alias("v")).where(F.col("v").isNotNull()).select("v.*")
    ranks = spark.createDataFrame(
        [(c, q, state[(c, q)]["r0"] - state[(c, q)]["below"],
          state[(c, q)]["r1"] - state[(c, q)]["below"],
          state[(c, q)]["pos"] - state[(c, q)]["r0"]) for c, q in live],
        "column_name string, q double, k0 long, k1 long, frac double")
    w = (Window.partitionBy("column_name", "q").orderBy("x")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dist = (cand.groupBy("column_name", "q", "x").agg(F.count(F.lit(1)).alias("cnt"))
            .withColumn("cum", F.sum("cnt").over(w))
            .join(F.broadcast(ranks), ["column_name", "q"]))
    return (dist.groupBy("column_name", "q")
            .agg(F.min(F.when(F.col("cum") > F.col("k0"), F.col("x"))).alias("x0"),
                 F.min(F.when(F.col("cum") > F.col("k1"), F.col("x"))).alias("x1"),
                 F.max("frac").alias("frac"))
            .select("column_name", "q",
                    (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("frac")).alias("value")))
