"""Declarative transforms.

A transform chain is a list of dicts ``{"type": ..., ...}`` applied in order
with ``DataFrame.transform``; the whole chain is one logical plan that
Catalyst optimises (filters pushed to the scan, unused columns pruned).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class TransformError(ValueError):
    pass


# ----------------------------------------------------------------- P1-P5

def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    """SQL condition string or Column."""
    return df.filter(F.expr(condition) if isinstance(condition, str) else condition)


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """P2."""
    return df.select(*columns)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Old -> new; unknown names are ignored like ``withColumnsRenamed``."""
    return df.withColumnsRenamed(dict(mapping))


def add_column(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """Computed column from a SQL expression."""
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def aggregate(df: DataFrame, group_by: list[str], aggregations: Mapping[str, str]) -> DataFrame:
    """``{"alias": "sum(amount)"}`` per group (partial aggregation map-side).
    Saved with a table sink (K6) this is the pre-aggregated KPI table (A24)."""
    aggs = [F.expr(e).alias(a) for a, e in aggregations.items()]
    if not aggs:
        raise TransformError("aggregate needs at least one aggregation")
    return df.groupBy(*group_by).agg(*aggs)


def custom_sql(df: DataFrame, sql: str, view: str = "source",
               args: dict | None = None) -> DataFrame:
    """Free SQL over the incoming frame, exposed as ``{view}``.

    The frame is passed as a DataFrame argument and named by a CTE around the
    query, so the text is not rewritten (a column may share the view's name)
    and no global temp view leaks between tenants. ``{view}`` in the text
    means the same as the plain name.
    """
    body = sql.replace("{" + view + "}", view).replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(
        f"WITH `{view}` AS (SELECT * FROM {{__frame}}) SELECT * FROM (\n{body}\n)",
        args=args or None, __frame=df)


_PARAM = re.compile(r"'\$\{(\w+)\}'|\$\{(\w+)\}")
_LITERAL = re.compile(r"'(?:[^']|'')*'")


def parameterized_sql(spark: SparkSession, sql: str, parameters: Mapping[str, object],
                      **frames: DataFrame) -> DataFrame:
    """``'${start_date}'`` placeholders become named parameter markers
    ``:start_date`` bound with typed values (no string splicing)."""
    inside = [x for x in _LITERAL.findall(sql) if "${" in x and not _PARAM.fullmatch(x)]
    if inside:
        raise TransformError(f"a placeholder can't be part of a longer literal: {inside}; "
                             "join the parts with concat")
    missing = [a or b for a, b in _PARAM.findall(sql) if (a or b) not in parameters]
    if missing:
        raise TransformError(f"missing parameters: {sorted(set(missing))}")
    q = _PARAM.sub(lambda m: ":" + (m[1] or m[2]), sql)
    return spark.sql(q, args=dict(parameters), **frames)


def ingest_metadata(df: DataFrame, organization: str, environment: str,
                    ts: Column | None = None) -> DataFrame:
    """P10: ingestion timestamp, organization and environment columns."""
    return df.withColumns({
        "ingestion_timestamp": ts if ts is not None else F.current_timestamp(),
        "organization": F.lit(organization),
        "environment": F.lit(environment),
    })


def incremental_filter(df: DataFrame, column: str, last_value=None) -> DataFrame:
    """Strict ``column > last_value``; no filter when there is no value.

    The comparison is on a literal so parquet/JDBC push it into the scan.
    """
    if last_value is None:
        return df
    lit = F.lit(last_value)
    if hasattr(last_value, "isoformat"):
        # a datetime/date mark becomes a literal of the column's own type via
        # its text form, so no session-time-zone conversion is involved
        text = last_value.isoformat(sep=" ") if hasattr(last_value, "hour") \
            else last_value.isoformat()
        lit = F.lit(text).cast(df.schema[column].dataType)
    return df.filter(F.col(column) > lit)


def high_water_mark(df: DataFrame, column: str, source: str) -> DataFrame:
    """The new high-water mark of a batch as a one-row frame
    ``(source, column, last_value, value_type)`` to append to a watermarks
    table after a successful write (a partial ``max``; no data is collected).
    The value is kept as text with its type."""
    return df.agg(F.max(column).cast("string").alias("last_value")).select(
        F.lit(source).alias("source"), F.lit(column).alias("column"), "last_value",
        F.lit(df.schema[column].dataType.simpleString()).alias("value_type"))


_NUMERIC = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def latest_marks(watermarks: DataFrame) -> DataFrame:
    """P12 read side: the largest mark per ``(source, column)`` in the order
    of its type (numbers as numbers; dates and timestamps read as text in
    their own order). Marks of empty batches are null and never win."""
    number = F.when(F.col("value_type").rlike(_NUMERIC), F.col("last_value").try_cast("double"))
    exact = F.when(F.col("value_type").rlike(_NUMERIC),
                   F.col("last_value").try_cast("decimal(38,10)"))
    return (watermarks.where(F.col("last_value").isNotNull()).groupBy("source", "column")
            .agg(F.max_by(F.struct("last_value", "value_type"),
                          F.struct(F.coalesce(exact, number.cast("decimal(38,10)")), number,
                                   "last_value")).alias("m"))
            .select("source", "column", "m.last_value", "m.value_type"))


def last_value_from(watermarks: DataFrame, source: str, column: str) -> DataFrame:
    """The latest stored mark for one ``(source, column)``."""
    return latest_marks(watermarks.where((F.col("source") == source) &
                                         (F.col("column") == column)))


# Names accepted by ``cast_columns`` (logical -> Spark type).
LOGICAL_TYPES = {"int": "int", "integer": "int", "bigint": "bigint", "long": "bigint",
                 "float": "double", "double": "double", "string": "string",
                 "date": "date", "datetime": "timestamp", "timestamp": "timestamp",
                 "boolean": "boolean", "bool": "boolean"}


def cast_columns(df: DataFrame, types: Mapping[str, str],
                 flag_column: str = "_cast_errors") -> DataFrame:
    """``try_cast`` each column; the names of columns whose non-null
    value did not convert are listed in ``flag_column`` (for a rejects split)."""
    errs = []
    out = {}
    for c, t in types.items():
        st = LOGICAL_TYPES.get(t.lower(), t)
        casted = F.expr(f"try_cast(`{c}` AS {st})")
        out[c] = casted
        errs.append(F.when(F.col(c).isNotNull() & casted.isNull(), F.lit(c)))
    flags = F.filter(F.array(*errs), lambda x: x.isNotNull()) if errs else F.array()
    return df.withColumn(flag_column, flags).withColumns(out)


def existing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Keep only columns present in the frame; error when none are."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise TransformError(f"the dataset has none of the columns {columns}")
    return present


def join_with(df: DataFrame, other: DataFrame, on, how: str = "left") -> DataFrame:
    """Enrichment join; Catalyst and AQE pick the strategy from sizes."""
    return df.join(other, on=on, how=how)


# ----------------------------------------------------------------- chain

def _t_join(df, spec, frames):
    other = frames[spec["with"]] if isinstance(spec["with"], str) else spec["with"]
    return join_with(df, other, spec["on"], spec.get("how", "left"))


TRANSFORMS: dict[str, Callable] = {
    "filter": lambda df, s, fr: filter_rows(df, s["condition"]),
    "select": lambda df, s, fr: select_columns(df, s["columns"]),
    "rename": lambda df, s, fr: rename_columns(df, s["mapping"]),
    "add_column": lambda df, s, fr: add_column(df, s["name"], s["expression"]),
    "aggregate": lambda df, s, fr: aggregate(df, s.get("group_by", []), s["aggregations"]),
    "custom_sql": lambda df, s, fr: custom_sql(df, s["sql"], s.get("view", "source"),
                                               s.get("args")),
    "cast": lambda df, s, fr: cast_columns(df, s["types"]),
    "join": _t_join,
    "incremental": lambda df, s, fr: incremental_filter(df, s["column"], s.get("last_value")),
}


def apply_transforms(df: DataFrame, transforms: list[dict] | None,
                     frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Apply an ordered chain; an empty chain is the identity.

    Unknown transform types raise instead of being skipped silently.
    """
    if not transforms:
        return df
    for t in transforms:
        if t.get("type") not in TRANSFORMS:
            raise TransformError(f"unknown transform type: {t.get('type')}")
    return functools.reduce(
        lambda d, t: d.transform(lambda x: TRANSFORMS[t["type"]](x, t, frames or {})),
        transforms, df)
