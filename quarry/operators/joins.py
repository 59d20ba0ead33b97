"""Join helpers.

No side is hinted: Catalyst broadcasts what its size estimate allows, and AQE
switches to a broadcast join from the bytes a side was measured to have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def membership_flag(df: DataFrame, column: str, ref: DataFrame, ref_column: str,
                    flag: str) -> DataFrame:
    """Add boolean ``flag`` = value is in the set of non-null
    reference values. The reference side is deduplicated first (partial
    aggregation per task), so the left join keeps the row count of ``df``."""
    keys = (ref.select(F.col(ref_column).alias("__ref_key"))
            .where(F.col("__ref_key").isNotNull()).distinct()
            .withColumn(flag, F.lit(True)))
    out = df.join(keys, df[column] == keys["__ref_key"], "left").drop("__ref_key")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def orphans(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """J2 bad rows: non-null keys without a reference row (``left_anti``)."""
    keys = ref.select(F.col(ref_column).alias("__ref_key")).where(F.col("__ref_key").isNotNull())
    return df.where(F.col(column).isNotNull()).join(
        keys, F.col(column) == F.col("__ref_key"), "left_anti")


def accuracy_flag(df: DataFrame, keys: list[str], target_column: str, ref: DataFrame,
                  ref_keys: list[str], ref_column: str, flag: str) -> DataFrame:
    """A row is accurate when a reference row with the same key exists and
    its value equals the target value null-safely. The reference is reduced to
    one value per key first (``max`` is deterministic); unmatched rows count
    as inaccurate."""
    r = (ref.groupBy(*[F.col(k).alias(f"__rk{i}") for i, k in enumerate(ref_keys)])
         .agg(F.max(ref_column).alias("__ref_val"))
         .withColumn("__matched", F.lit(True)))
    cond = None
    for i, k in enumerate(keys):
        c = df[k] == r[f"__rk{i}"]
        cond = c if cond is None else cond & c
    out = df.join(r, cond, "left")
    ok = F.coalesce(F.col("__matched"), F.lit(False)) & \
        F.col(target_column).eqNullSafe(F.col("__ref_val"))
    drop = [f"__rk{i}" for i in range(len(keys))] + ["__ref_val", "__matched"]
    return out.withColumn(flag, ok).drop(*drop)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key as a two-stage ``max_by`` aggregate.

    ``max_by(struct(row), struct(order))`` is partially aggregated map-side,
    so a key holding a large share of rows never lands whole in one task
    (a ``row_number`` window would sort the whole key in one task).
    """
    cols = [c for c in df.columns]
    order_struct = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)])
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols if c not in keys]),
                          order_struct).alias("__r"))
            .select(*keys, "__r.*"))
