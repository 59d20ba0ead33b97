"""Remediation (R1-R6, W3): route failures, split, fix, reject, record.

All outputs are DataFrames derived from the row flags and the fused rule
results; nothing is moved through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.predicates import email_loose
from quarry.operators.joins import latest_per_key
from quarry.operators.quality.engine import row_flags
from quarry.operators.quality.spec import Rule


def quarantine_split(df: DataFrame, rules: list[Rule], frames: dict | None = None,
                     as_of=None) -> tuple[DataFrame, DataFrame]:
    """R2: ``good`` rows (no rule failed) and ``bad`` rows with the ids of the
    failed rules and the reasons. ``good ∪ bad = input``; the flagged frame
    is computed once per consumer (persist or write it when both are used)."""
    flagged = row_flags(df, rules, frames, as_of, strict=True)
    good = flagged.where(F.size("_failed_rules") == 0).drop("_failed_rules", "_reasons")
    bad = flagged.where(F.size("_failed_rules") > 0)
    return good, bad


def split_write(df: DataFrame, rules: list[Rule], path: str, frames: dict | None = None,
                as_of=None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """R2 in one job: rows are flagged once and written partitioned by
    ``_part`` (``good`` rows, ``bad`` rows with the failed rule ids and
    reasons), so the input is scanned and checked a single time."""
    flagged = row_flags(df, rules, frames, as_of, strict=True)
    (flagged.withColumn("_part", F.when(F.size("_failed_rules") > 0, "bad").otherwise("good"))
     .write.mode(mode).format(fmt).partitionBy("_part").save(path))


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W3/R3 for uniqueness: one row per key, the first under ``order``.

    Implemented as ``min_by`` over the ordering struct with partial
    aggregation, so a hot key is reduced inside each task before the
    shuffle rather than sorted whole in one task by a window."""
    cols = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)])
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), ordering).alias("__r"))
            .select(*keys, "__r.*"))


def unfixable(df: DataFrame, rules: list[Rule]) -> list[str]:
    """Ids of rules that ``auto_fix`` has no fix for."""
    def known(r: Rule) -> bool:
        d = r.definition
        if r.rule_type == "uniqueness":
            return all(k in df.columns for k in d.get("columns") or [r.column])
        return r.column in df.columns and (
            (r.rule_type == "completeness" and "default" in d) or r.rule_type == "range_check" or
            (r.rule_type == "validity" and d.get("data_type") == "email") or
            (r.rule_type == "conformity" and d.get("standard") == "EMAIL") or
            (r.rule_type == "regex_pattern" and bool(d.get("pattern"))))
    return [r.rule_id for r in rules if not known(r.normalized())]


def auto_fix(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Deterministic fixes by rule type.

    completeness -> fill ``definition.default`` (when given); range_check ->
    clamp into [min, max]; validity with data_type email / conformity EMAIL ->
    trim + lower, then null-out if still invalid; regex_pattern -> null-out
    values that do not match; uniqueness -> one row per key, the first in
    the order of ``definition.order_by`` (else of all other columns).
    Other rules have no fix (``unfixable``) and are an error here.
    """
    odd = unfixable(df, rules)
    if odd:
        raise ValueError(f"rules without a fix: {odd}")
    out = df
    for r in (x.normalized() for x in rules):
        c, d = r.column, r.definition
        if r.rule_type == "uniqueness":
            keys = d.get("columns") or [c]
            rest = d.get("order_by") or [x for x in out.columns if x not in keys]
            out = dedupe_keep_first(out, keys, [F.col(x) for x in rest]).select(*out.columns)
            continue
        col = F.col(c)
        if r.rule_type == "completeness" and "default" in d:
            out = out.withColumn(c, F.coalesce(col, F.lit(d["default"]).cast(
                out.schema[c].dataType)))
        elif r.rule_type == "range_check":
            lo, hi = d.get("min_value"), d.get("max_value")
            v = col
            if lo is not None:
                v = F.when(v < F.lit(lo), F.lit(lo)).otherwise(v)
            if hi is not None:
                v = F.when(v > F.lit(hi), F.lit(hi)).otherwise(v)
            out = out.withColumn(c, v.cast(out.schema[c].dataType))
        elif (r.rule_type == "validity" and d.get("data_type") == "email") or \
                (r.rule_type == "conformity" and d.get("standard") == "EMAIL"):
            v = F.lower(F.trim(col))
            out = out.withColumn(c, F.when(email_loose(v), v))
        elif r.rule_type == "regex_pattern" and d.get("pattern"):
            out = out.withColumn(c, F.when(col.cast("string").rlike("^(?:" + d["pattern"] + ")"),
                                           col))
    return out


def route(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Failed results joined to their rule's remediation action."""
    return (results.where(F.col("status") == "failed")
            .join(rules.select(F.col("id").alias("rule_id"),
                               F.coalesce("remediation_action", F.lit("alert_only"))
                               .alias("action")), "rule_id", "left")
            .withColumn("action", F.coalesce("action", F.lit("alert_only"))))


def reject_batch(results: DataFrame, routed: DataFrame | None = None) -> DataFrame:
    """One row per batch; ``failed`` when any failed rule asks to reject."""
    src = routed if routed is not None else results.withColumn("action", F.lit(None))
    return (src.groupBy("batch_id")
            .agg(F.max(F.when((F.col("status") == "failed") & (F.col("action") == "reject"), 1)
                       .otherwise(0)).alias("__rej"))
            .select("batch_id", F.when(F.col("__rej") == 1, "failed").otherwise("success")
                    .alias("run_status")))


# Fixed value: how an incident's title begins.
INCIDENT_TITLE = "Quality Rule Failure: "


def incidents(routed: DataFrame) -> DataFrame:
    """Manual-review failures become incident rows."""
    return (routed.where(F.col("action") == "manual_review")
            .select("organization_id", "rule_id",
                    F.concat(F.lit(INCIDENT_TITLE), F.col("rule_type"))
                    .alias("incident_type"),
                    "severity", F.coalesce("dataset_name", F.lit("unknown")).alias("dataset_name"),
                    F.format_string("Rule '%s' failed with %d failed records",
                                    F.col("rule_name"), F.col("failed_records"))
                    .alias("description"),
                    F.col("failed_records").alias("affected_records"),
                    F.col("details").alias("remediation_details")))


def alerts(routed: DataFrame) -> DataFrame:
    """Alert-only failures become alert rows (deduplicated by W5)."""
    return (routed.where(F.col("action") == "alert_only")
            .select(F.lit("Data quality check failed").alias("name"),
                    F.lit("data-quality").alias("service"), "organization_id",
                    F.format_string("%s failed (%d records)", F.col("rule_name"),
                                    F.col("failed_records")).alias("message"),
                    "severity", F.col("executed_at").alias("created_at")))


def latest_alert_state(alerts_df: DataFrame) -> DataFrame:
    """Newest alert per (name, service, organization)."""
    return latest_per_key(alerts_df, ["name", "service", "organization_id"],
                          [F.col("created_at")])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q26: keys that occur more than once, with the number ``n`` of their rows. Null
    is a value like others. Counted in each task first, so a key of any share of the
    rows shuffles one row per task; no window."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q26: all rows whose key occurs more than once, with ``n``. The keys are joined
    back null-safe; AQE splits a large key on the side of the rows."""
    found = duplicate_keys(df, keys)
    own = found.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)],
                       F.col("n").alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    return df.join(own, same).select(*[F.col(f"`{c}`") for c in df.columns],
                                     F.col("__n").alias("n"))
