"""Fused rule execution (Q19, Q21, Q27, A6-A8) and row-level flags (R2).

``run_rules`` plans every scan-based rule into ONE aggregate over the
dataset (plus one left join per reference table), then turns the single
aggregate row into one result row per rule with ``explode`` — no per-rule
scans, no union of N jobs, nothing collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.predicates import ratio
from quarry.operators.quality.checks import Check, compile_rule
from quarry.operators.quality.spec import Rule
from quarry.operators.topk import tree_top
from quarry.session import cut_lineage

RESULT_SCHEMA = (
    "rule_id string, rule_name string, rule_type string, severity string, status string, "
    "pass_rate double, failed_records bigint, total_records bigint, threshold double, "
    "details string, error string, organization_id string, dataset_name string, "
    "batch_id string, executed_at timestamp")

RESULT_COLUMNS = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]

# Exact distinct aggregates expand the input once per distinct set; keep at
# most this many per fused aggregate and start another pass beyond it.
MAX_DISTINCT_PER_PASS = 8


def compile_rules(df: DataFrame, rules: list[Rule], frames: dict | None = None,
                  as_of=None) -> list[Check]:
    return [compile_rule(df, r, f"r{i}", frames, as_of) for i, r in enumerate(rules)
            if r.is_active]


def _status(pass_rate: Column, failed: Column, total: Column, check: Check,
            threshold: float) -> Column:
    warn = check.rule.definition.get("warning_threshold")
    passed = (failed == 0) if check.passes_if_no_failures else (pass_rate >= F.lit(threshold))
    s = F.when(total == 0, F.lit("error")).when(passed, F.lit("passed"))
    if warn is not None:
        s = s.when(pass_rate >= F.lit(float(warn)), F.lit("warning"))
    return s.otherwise(F.lit("failed"))


def _result_struct(check: Check, get, total: Column, ctx: dict) -> Column:
    r = check.rule
    thr = r.threshold()
    if check.error is not None:
        fields = {"status": F.lit("error"), "pass_rate": F.lit(None).cast("double"),
                  "failed_records": F.lit(None).cast("bigint"), "total_records": total,
                  "details": F.lit(None).cast("string"), "error": F.lit(check.error)}
    else:
        b = check.build(get, total)
        if "pass_rate" in b:
            pr = b["pass_rate"]
        else:
            pr = ratio(b["passed_count"], total, check.empty_rate)
        failed = b["failed_records"].cast("bigint")
        fields = {"status": _status(pr, failed, total, check, thr), "pass_rate": pr,
                  "failed_records": failed, "total_records": total,
                  "details": b["details"],
                  "error": F.when(total == 0, F.lit("dataset is empty"))}
    return F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.display_name).alias("rule_name"),
        F.lit(r.rule_type).alias("rule_type"), F.lit(r.severity).alias("severity"),
        fields["status"].alias("status"), fields["pass_rate"].cast("double").alias("pass_rate"),
        fields["failed_records"].cast("bigint").alias("failed_records"),
        fields["total_records"].cast("bigint").alias("total_records"),
        F.lit(float(thr)).alias("threshold"), fields["details"].alias("details"),
        fields["error"].cast("string").alias("error"),
        F.lit(ctx.get("organization_id")).cast("string").alias("organization_id"),
        F.lit(ctx.get("dataset_name")).cast("string").alias("dataset_name"),
        F.lit(ctx.get("batch_id")).cast("string").alias("batch_id"),
        (F.lit(ctx["executed_at"]).cast("timestamp") if ctx.get("executed_at") is not None
         else F.current_timestamp()).alias("executed_at"))


def _passes(checks: list[Check]) -> list[list[Check]]:
    """Plain aggregates share one pass; exact distinct counts, which expand
    every row they share a pass with, go to passes of their own."""
    plain = [c for c in checks if not c.n_distinct]
    groups: list[list[Check]] = [plain, []]
    nd = 0
    for c in (c for c in checks if c.n_distinct):
        if nd + c.n_distinct > MAX_DISTINCT_PER_PASS and groups[-1]:
            groups.append([])
            nd = 0
        groups[-1].append(c)
        nd += c.n_distinct
    return groups


def run_checks(df: DataFrame, checks: list[Check], ctx: dict | None = None,
               group_by: list[str] | None = None,
               isolate_runtime_errors: bool = False) -> DataFrame:
    """Execute compiled checks as fused passes; returns the result rows.

    With ``group_by`` (e.g. tenant, partition date) every rule is evaluated
    per group in the same single aggregation and the group columns lead the
    result rows; custom SQL rules are whole-dataset rules (one row, NULL
    group columns).

    Planning errors are always isolated per rule. With
    ``isolate_runtime_errors`` each pass is also executed right away (its
    aggregate row is staged in the checkpoint folder); if it fails at run
    time (say an ANSI division by zero in a user condition), the pass is
    re-run rule by rule and only the failing rules become ``error`` rows.
    """
    ctx = dict(ctx or {})
    group_by = list(group_by or [])
    spark = df.sparkSession
    scan = [c for c in checks if c.sql_plan is None]
    sql = [c for c in checks if c.sql_plan is not None]
    outs: list[DataFrame] = []
    pending = [g for g in _passes(scan) if g]
    while pending:
        group = pending.pop(0)
        base = df
        for c in group:
            if c.error is None and c.prep is not None:
                base = c.prep(base)
        aggs = [F.count(F.lit(1)).alias("__total")]
        for c in group:
            if c.error is None:
                aggs += [e.alias(n) for n, e in c.aggs.items()]
        row = base.groupBy(*group_by).agg(*aggs) if group_by else base.agg(*aggs)
        if isolate_runtime_errors:
            try:
                row = cut_lineage(row)
            except Exception as exc:  # noqa: BLE001 - any runtime failure of user input
                live = [c for c in group if c.error is None]
                if len(live) > 1:
                    pending = [[c] for c in group] + pending
                    continue
                for c in live:
                    c.error = f"runtime error: {type(exc).__name__}: {exc}"
                row = df.groupBy(*group_by).agg(aggs[0]) if group_by else df.agg(aggs[0])
        total = F.col("__total")
        structs = [_result_struct(c, F.col, total, ctx) for c in group]
        outs.append(row.select(*group_by, F.explode(F.array(*structs)).alias("r"))
                    .select(*group_by, "r.*"))
    # custom SQL rules judge the dataset as a whole: with ``group_by`` they
    # are reported once, with NULL group columns
    for c in sql:
        outs.append(_custom_sql_result(c, ctx))
    if not outs:
        return spark.createDataFrame([], RESULT_SCHEMA)
    # Results of several passes / SQL rules appended by name
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o, allowMissingColumns=bool(group_by))
    return out


def _custom_sql_result(check: Check, ctx: dict) -> DataFrame:
    """Q18: expected ``pass`` = no rows, ``fail`` = some rows, a number = exactly
    that many rows, anything else compared as text with the row count."""
    r = check.rule
    exp = r.definition.get("expected_result", "pass")
    n = F.col("n_rows")
    if exp == "pass":
        ok = n == 0
    elif exp == "fail":
        ok = n > 0
    elif isinstance(exp, (int, float)) and not isinstance(exp, bool):
        ok = n == F.lit(exp)
    else:
        ok = n.cast("string") == F.lit(str(exp))
    s = F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.display_name).alias("rule_name"),
        F.lit(r.rule_type).alias("rule_type"), F.lit(r.severity).alias("severity"),
        F.when(ok, "passed").otherwise("failed").alias("status"),
        F.when(ok, 1.0).otherwise(0.0).alias("pass_rate"),
        n.cast("bigint").alias("failed_records"), n.cast("bigint").alias("total_records"),
        F.lit(float(r.threshold())).alias("threshold"),
        F.to_json(F.struct(F.lit(str(exp)).alias("expected_result"),
                           n.alias("row_count"))).alias("details"),
        F.lit(None).cast("string").alias("error"),
        F.lit(ctx.get("organization_id")).cast("string").alias("organization_id"),
        F.lit(ctx.get("dataset_name")).cast("string").alias("dataset_name"),
        F.lit(ctx.get("batch_id")).cast("string").alias("batch_id"),
        (F.lit(ctx["executed_at"]).cast("timestamp") if ctx.get("executed_at") is not None
         else F.current_timestamp()).alias("executed_at"))
    return check.sql_plan.select(s.alias("r")).select("r.*")


def run_rules(df: DataFrame, rules: list[Rule], frames: dict | None = None, as_of=None,
              ctx: dict | None = None, group_by: list[str] | None = None,
              isolate_runtime_errors: bool = False) -> DataFrame:
    """Compile + run: the quality-check entry point (3.2)."""
    return run_checks(df, compile_rules(df, rules, frames, as_of), ctx, group_by,
                      isolate_runtime_errors)


# ---------------------------------------------------------------- row flags (R2)

def without_row_form(df: DataFrame, rules: list[Rule], frames: dict | None = None,
                     as_of=None) -> dict[str, str]:
    """Rules whose failing rows can't be told, with the reason."""
    return {c.rule.rule_id: c.error or f"{c.rule.rule_type} judges the dataset as a whole"
            for c in compile_rules(df, rules, frames, as_of)
            if c.error is not None or (c.row_valid is None and c.rule.rule_type != "uniqueness")}


def row_flags(df: DataFrame, rules: list[Rule], frames: dict | None = None, as_of=None,
              strict: bool = False) -> DataFrame:
    """Per-row failure flags for every row-level rule, plus set-level
    uniqueness flags (rows whose key occurs more than once). A rule without
    a row form (``without_row_form``) flags nothing; with ``strict`` it is an
    error.

    Adds ``_failed_rules array<string>`` and ``_reasons array<string>``.
    Uniqueness duplicates come from a partial-aggregated ``groupBy(key).count``
    joined back (AQE splits a skewed key on the large side).
    """
    gaps = without_row_form(df, rules, frames, as_of) if strict else {}
    if gaps:
        raise ValueError(f"rules without a row form: {gaps}")
    checks = compile_rules(df, rules, frames, as_of)
    base = df
    for c in checks:
        if c.error is None and c.prep is not None:
            base = c.prep(base)
    failed, reasons = [], []
    for c in checks:
        if c.error is not None:
            continue
        r = c.rule
        if r.rule_type == "uniqueness":
            cols = r.definition.get("columns") or [r.column]
            cols = [x for x in cols if x in df.columns]
            name = f"__dup_{r.rule_id}"
            ks = [f"__k{i}_{r.rule_id}" for i in range(len(cols))]
            counts = (df.groupBy(*[F.col(x).alias(k) for x, k in zip(cols, ks)])
                      .agg(F.count(F.lit(1)).alias("__n"))
                      .where(F.col("__n") > 1).select(*ks, F.lit(True).alias(name)))
            cond = None
            for x, k in zip(cols, ks):
                e = F.col(x).eqNullSafe(F.col(k))
                cond = e if cond is None else cond & e
            base = base.join(counts, on=cond, how="left").drop(*ks)
            bad = F.coalesce(F.col(name), F.lit(False))
            failed.append(F.when(bad, F.lit(r.rule_id)))
            reasons.append(F.when(bad, F.lit(f"{r.rule_id}: duplicate key")))
            continue
        if c.row_valid is None:
            continue
        bad = ~F.coalesce(c.row_valid, F.lit(False))
        failed.append(F.when(bad, F.lit(r.rule_id)))
        if c.row_reasons is not None:
            reasons.append(F.when(bad, F.concat_ws("; ", c.row_reasons)))
        else:
            reasons.append(F.when(bad, F.lit(f"{r.rule_id}: {r.rule_type} failed")))
    keep = [c for c in base.columns if c in df.columns]
    arr = lambda xs: (F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs
                      else F.array().cast("array<string>"))
    return base.select(*keep, arr(failed).alias("_failed_rules"), arr(reasons).alias("_reasons"))


# ---------------------------------------------------------------- T3

def failure_samples(df: DataFrame, rules: list[Rule], key_columns: list[str],
                    k: int = 10, payload: list[str] | None = None, frames: dict | None = None,
                    as_of=None) -> DataFrame:
    """The first ``k`` failing rows per rule by key (deterministic).

    Ranked by ``tree_top``: no rule's failures are gathered whole."""
    payload = payload or [c for c in df.columns if c not in key_columns]
    flagged = row_flags(df, rules, frames, as_of)
    failed = flagged.select(*key_columns, *payload, F.explode("_failed_rules").alias("rule_id"))
    order = [F.col(c).asc_nulls_first() for c in key_columns]
    return tree_top(failed, ["rule_id"], order, k, "sample_rank") \
        .select("rule_id", "sample_rank", *key_columns, *payload)


# ---------------------------------------------------------------- Q25

def schema_diff(expected, df: DataFrame) -> DataFrame:
    """Q25: expected ``StructType`` vs the frame's schema: ``missing``,
    ``extra`` and ``type_changed`` columns (one row per finding)."""
    exp = {f.name: f.dataType.simpleString() for f in expected.fields}
    act = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, "missing", t, None) for c, t in exp.items() if c not in act]
    rows += [(c, "extra", None, t) for c, t in act.items() if c not in exp]
    rows += [(c, "type_changed", exp[c], act[c]) for c in exp if c in act and exp[c] != act[c]]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, issue string, expected_type string, actual_type string")


def check_record(spark, record: dict, rules: list[Rule], schema=None, as_of=None) -> DataFrame:
    """Q23: real-time rule run on one record (S13 one-row frame)."""
    from quarry.sources.files import single_record

    return run_rules(single_record(spark, record, schema), rules, as_of=as_of)
