"""Compile rules into fused-aggregate checks.

A ``Check`` contributes named aggregate expressions to ONE shared ``agg``
over the dataset, an optional ``prep`` step that adds a per-row flag column
(for join-based rules, each a left join to a deduplicated reference), an
optional row-level validity expression (used by quarantine / auto-fix), and
a ``build`` function that turns the aggregated columns into result fields.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType
from pyspark.errors import AnalysisException, ParseException

from quarry.functions import predicates as P
from quarry.operators import joins as J
from quarry.operators.quality.spec import Rule
from quarry.session import lenient


class RuleError(ValueError):
    """A rule that cannot be planned; it yields an ``error`` result row."""


@dataclass
class Check:
    rule: Rule
    aggs: dict[str, Column] = field(default_factory=dict)
    # build(get, total) -> {"passed_count"|"pass_rate", "failed_records", "details", ...}
    build: Callable | None = None
    row_valid: Column | None = None
    row_reasons: Column | None = None
    prep: Callable[[DataFrame], DataFrame] | None = None
    n_distinct: int = 0
    error: str | None = None
    sql_plan: DataFrame | None = None     # custom_sql: its own 1-row plan
    empty_rate: float = 0.0               # pass_rate when the dataset is empty
    passes_if_no_failures: bool = False   # engine uniqueness


def _col(df: DataFrame, name: str) -> Column:
    return df[name] if "." not in name else F.col(f"`{name}`")


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


def _require_column(df: DataFrame, rule: Rule, message: str | None = None) -> str:
    c = rule.column
    if not c or c not in df.columns:
        raise RuleError(message or f"Column '{c}' not found in dataset")
    return c


def _count_valid(valid: Column) -> Column:
    return F.count_if(F.coalesce(valid, F.lit(False)))


def _details(**kv) -> Column:
    items = []
    for k, v in kv.items():
        items.append((v if isinstance(v, Column) else F.lit(v)).alias(k))
    return F.to_json(F.struct(*items))


def _row_rule(rule: Rule, key: str, valid: Column, detail_fields: dict,
              reasons: Column | None = None, empty_rate: float = 1.0) -> Check:
    """A rule that is a per-row predicate counted in the fused agg."""
    name = f"{key}_valid"

    def build(get, total):
        ok = get(name)
        return {"passed_count": ok, "failed_records": total - ok,
                "details": _details(valid_records=ok, **detail_fields)}

    return Check(rule, aggs={name: _count_valid(valid)}, build=build,
                 row_valid=F.coalesce(valid, F.lit(False)), row_reasons=reasons,
                 empty_rate=empty_rate)


# ------------------------------------------------------------------ Q1 / A1 / A2

def completeness(df: DataFrame, rule: Rule, key: str) -> Check:
    c = rule.column
    if c and c in df.columns:
        name = f"{key}_nn"

        def build(get, total):
            nn = get(name)
            return {"passed_count": nn, "failed_records": total - nn,
                    "details": _details(column=c, non_null_records=nn, total_records=total,
                                        null_count=total - nn)}

        return Check(rule, aggs={name: F.count(_col(df, c))}, build=build,
                     row_valid=_col(df, c).isNotNull(), empty_rate=0.0)
    if rule.dialect == "engine":
        raise RuleError(f"Column {c} not found in dataset")
    # A2: whole-table completeness over every cell.
    names = {f"{key}_nn{i}": F.count(_col(df, col)) for i, col in enumerate(df.columns)}
    ncols = len(df.columns)

    def build_all(get, total):
        nn = sum((get(n) for n in names), F.lit(0))
        cells = total * F.lit(ncols)
        return {"pass_rate": P.ratio(nn, cells, 0.0), "failed_records": cells - nn,
                "details": _details(total_cells=cells, non_null_cells=nn)}

    return Check(rule, aggs=names, build=build_all, empty_rate=0.0)


# ------------------------------------------------------------------ Q2 / A3-A5

def uniqueness(df: DataFrame, rule: Rule, key: str) -> Check:
    d = rule.definition
    cols = d.get("columns") or ([rule.column] if rule.column else [])
    if not cols:
        raise RuleError("a uniqueness rule needs a column or columns")
    present = [c for c in cols if c in df.columns]
    if not present:
        raise RuleError(f"the dataset has none of the columns {cols}")
    name = f"{key}_distinct"
    null_policy = d.get("null_policy", "exclude")
    aggs = {}
    if len(present) == 1:
        c = _col(df, present[0])
        aggs[name] = F.count_distinct(c)                      # nulls excluded (A3)
        if null_policy == "count":                            # A5: null counts once
            aggs[f"{key}_hasnull"] = F.max(c.isNull().cast("int"))
    else:
        # A4: duplicates over the tuple; nulls compare equal and count.
        aggs[name] = F.count_distinct(F.struct(*[_col(df, c) for c in present]))

    def build(get, total):
        uniq = get(name)
        if null_policy == "count" and len(present) == 1:
            uniq = uniq + F.coalesce(get(f"{key}_hasnull"), F.lit(0))
        return {"passed_count": uniq, "failed_records": total - uniq,
                "details": _details(columns=F.array(*[F.lit(c) for c in present]),
                                    unique_records=uniq, duplicate_records=total - uniq)}

    return Check(rule, aggs=aggs, build=build, n_distinct=1,
                 empty_rate=0.0 if rule.dialect == "engine" else 1.0,
                 passes_if_no_failures=rule.dialect == "engine")


# ------------------------------------------------------------------ Q3 / Q4

# Per-row reason texts of the validity rule.
REASON_TEXT = {
    "pattern": "Pattern mismatch: {}",
    "data_type": "Invalid {}",
    "min": "Below minimum: {}",
    "max": "Above maximum: {}",
    "allowed_values": "Not in allowed values: {}",
}


def validity_reasons(df: DataFrame, c: str, d: dict) -> Column:
    """Q3 reasons array for one column; empty array = valid; NULL value valid."""
    col = _col(df, c)
    dt = _dtype(df, c)
    reasons = []
    if d.get("pattern") and isinstance(dt, StringType):
        reasons.append(F.when(~P.match_start(col, d["pattern"]),
                              F.lit(REASON_TEXT["pattern"].format(d["pattern"]))))
    if d.get("data_type"):
        reasons.append(F.when(~P.castable(col, dt, d["data_type"]),
                              F.lit(REASON_TEXT["data_type"].format(d["data_type"]))))
    rng = d.get("range") or {}
    if rng and P.is_numeric(dt):
        if rng.get("min") is not None:
            reasons.append(F.when(col < F.lit(rng["min"]),
                                  F.lit(REASON_TEXT["min"].format(rng["min"]))))
        if rng.get("max") is not None:
            reasons.append(F.when(col > F.lit(rng["max"]),
                                  F.lit(REASON_TEXT["max"].format(rng["max"]))))
    if d.get("allowed_values"):
        reasons.append(F.when(~P.allowed(col, d["allowed_values"]),
                              F.lit(REASON_TEXT["allowed_values"].format(d["allowed_values"]))))
    arr = F.filter(F.array(*reasons), lambda x: x.isNotNull()) if reasons else \
        F.array().cast("array<string>")
    return F.when(col.isNull(), F.array().cast("array<string>")).otherwise(arr)


def validity(df: DataFrame, rule: Rule, key: str) -> Check:
    c = _require_column(df, rule)
    d = rule.definition
    if rule.dialect == "engine":
        return _engine_validity(df, rule, key, c)
    reasons = validity_reasons(df, c, d)
    return _row_rule(rule, key, F.size(reasons) == 0, {"column": c}, reasons=reasons)


def _engine_validity(df: DataFrame, rule: Rule, key: str, c: str) -> Check:
    d = rule.definition
    et = d.get("expected_type", "string")
    col, dt = _col(df, c), _dtype(df, c)
    allow_null = F.lit(bool(d.get("allow_null", False)))
    if et == "integer":
        v = P.castable(col, dt, "int") if isinstance(dt, StringType) else \
            F.lit(isinstance(dt, IntegralType))
        valid = F.when(col.isNull(), allow_null).otherwise(v)
    elif et == "float":
        v = P.castable(col, dt, "float")
        valid = F.when(col.isNull(), allow_null).otherwise(v)
    elif et == "string":
        valid = F.when(col.isNull(), allow_null).otherwise(F.lit(isinstance(dt, StringType)))
    elif et == "datetime":
        valid = P.as_timestamp(col, dt).isNotNull()
    elif et == "email":
        valid = P.email_strict(col) if isinstance(dt, StringType) else F.lit(False)
    else:
        raise RuleError(f"unknown expected_type: {et}")
    return _row_rule(rule, key, valid, {"column": c, "expected_type": et}, empty_rate=0.0)


# ------------------------------------------------------------------ Q5-Q7, Q10

def _condition_rule(df: DataFrame, rule: Rule, key: str, conditions: list[str], details: dict,
                    empty_rate: float = 1.0) -> Check:
    """A rule whose rows have to meet user conditions. A row for which a
    condition is null or can't be worked out (a division by zero, a text that
    is no number) does not meet it; it never fails the run."""
    names = [f"{key}_cond{i}" for i in range(len(conditions))]

    def prep(x: DataFrame) -> DataFrame:
        with lenient(x.sparkSession):
            return x.withColumns({n: F.coalesce(F.expr(c), F.lit(False))
                                  for n, c in zip(names, conditions)})

    for c in conditions:
        try:
            with lenient(df.sparkSession):
                df.where(F.expr(c)).schema  # analysis only; nothing runs
        except (AnalysisException, ParseException) as exc:
            raise RuleError(f"invalid condition: {c}: {exc.getCondition()}") from None
    valid = functools.reduce(lambda a, b: a & b, [F.col(n) for n in names])
    out = _row_rule(rule, key, valid, details, empty_rate=empty_rate)
    out.prep = prep
    return out


def consistency(df: DataFrame, rule: Rule, key: str) -> Check:
    d = rule.definition
    ctype = d.get("type", "cross_column")
    if ctype == "temporal":
        return temporal_consistency(df, rule, key)
    if ctype == "referential":
        return reference_integrity(df, rule, key)
    if ctype != "cross_column":
        raise RuleError(f"Unknown consistency type: {ctype}")
    # Conditions are SQL expressions (``F.expr``), never Python
    # ``eval``; ``column1``/``column2`` placeholders become quoted names.
    if d.get("condition") or d.get("sql_expression"):
        cond = d.get("condition") or d["sql_expression"]
    elif d.get("column1") and d.get("column2") and d.get("rule"):
        cond = (d["rule"].replace("column1", f"`{d['column1']}`")
                .replace("column2", f"`{d['column2']}`"))
    else:
        raise RuleError("a cross-column rule needs a condition")
    return _condition_rule(df, rule, key, [cond], {"condition": cond},
                           0.0 if rule.dialect == "engine" else 1.0)


def temporal_consistency(df: DataFrame, rule: Rule, key: str) -> Check:
    cols = rule.definition.get("date_columns", [])
    if len(cols) < 2:
        raise RuleError("a temporal rule needs two date columns or more")
    present = [c for c in cols if c in df.columns]
    ts = F.filter(F.array(*[P.as_timestamp(_col(df, c), _dtype(df, c)) for c in present]),
                  lambda x: x.isNotNull())
    valid = ts == F.array_sort(ts)   # non-decreasing after dropping nulls
    return _row_rule(rule, key, valid, {"date_columns": F.array(*[F.lit(c) for c in cols])})


def business_rule(df: DataFrame, rule: Rule, key: str) -> Check:
    conds = rule.definition.get("conditions") or []
    if not conds:
        raise RuleError("business_rule accuracy requires conditions")
    return _condition_rule(df, rule, key, conds,
                           {"conditions": F.array(*[F.lit(c) for c in conds])})


# ------------------------------------------------------------------ Q9 / Q11 / J3

def accuracy(df: DataFrame, rule: Rule, key: str, frames: dict) -> Check:
    d = rule.definition
    method = d.get("method", "reference")
    if method == "statistical":
        return statistical_accuracy(df, rule, key)
    if method == "iqr":
        return quartile_accuracy(df, rule, key)
    if method == "business_rule":
        return business_rule(df, rule, key)
    src, ref_col, target = d.get("reference_source"), d.get("reference_column"), rule.column
    if not src or not target:
        raise RuleError("an accuracy rule needs a reference source and a target column")
    if target not in df.columns:
        raise RuleError(f"Column '{target}' not found in dataset")
    ref = frames.get(src) if isinstance(src, str) else src
    if ref is None:
        raise RuleError(f"reference source '{src}' is not available")
    keys = d.get("keys") or []
    ref_keys = d.get("reference_keys") or keys
    if not keys or any(k not in df.columns for k in keys):
        raise RuleError("accuracy needs join keys present in the dataset")
    flag = f"{key}_acc"
    def prep(x: DataFrame) -> DataFrame:
        return J.accuracy_flag(x, keys, target, ref, ref_keys, ref_col or target, flag)
    name = f"{key}_ok"

    def build(get, total):
        ok = get(name)
        return {"passed_count": ok, "failed_records": total - ok,
                "details": _details(reference_source=str(src), accurate_records=ok)}

    return Check(rule, aggs={name: F.count_if(F.col(flag))}, build=build, prep=prep,
                 row_valid=F.col(flag), empty_rate=1.0)


def statistical_accuracy(df: DataFrame, rule: Rule, key: str) -> Check:
    """Q11 (intent chosen): share of values with |z| <= ``z`` (default 3)
    against the column's mean and sample standard deviation; NULL passes."""
    c = _require_column(df, rule)
    z = float(rule.definition.get("z", 3.0))
    col = _col(df, c).cast("double")
    n_mean, n_std, n_ok = f"{key}_mean", f"{key}_std", f"{key}_zok"
    # The z test needs the global mean/std first: one uncorrelated scalar
    # subquery (a partial+final aggregate evaluated once and inlined as a
    # constant) - no window over the whole frame, no join.

    def prep(x: DataFrame) -> DataFrame:
        stats = df.select(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))).scalar()
        return x.withColumns({n_mean: stats["m"], n_std: stats["s"]})

    dev = F.abs(col - F.col(n_mean))
    valid = col.isNull() | F.coalesce(dev <= F.lit(z) * F.col(n_std), dev == 0)

    def build(get, total):
        ok = get(n_ok)
        return {"passed_count": ok, "failed_records": total - ok,
                "details": _details(z=z, mean=get(f"{key}_m"), std=get(f"{key}_s"))}

    return Check(rule, aggs={n_ok: F.count_if(valid), f"{key}_m": F.max(n_mean),
                             f"{key}_s": F.max(n_std)},
                 build=build, prep=prep, row_valid=valid, empty_rate=1.0)


def quartile_accuracy(df: DataFrame, rule: Rule, key: str) -> Check:
    """Q11, robust form (``method: iqr``): share of values within ``k`` (default
    1.5) interquartile ranges of the quartiles; NULL passes. Outliers don't move
    the bounds, as they do the mean and deviation of the z test. The quartiles are
    selected exactly (``exact_quantiles``: a few passes that count, no column in one
    task) and enter the fused run as a scalar, like the mean of the z test."""
    from quarry.operators.profile import exact_quantiles

    c = _require_column(df, rule)
    k = float(rule.definition.get("k", 1.5))
    col = _col(df, c).cast("double")
    low, high, name = f"{key}_q1", f"{key}_q3", f"{key}_iok"

    def prep(x: DataFrame) -> DataFrame:
        q = exact_quantiles(df, [c], [0.25, 0.75])
        at = q.select(F.struct(
            F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))).scalar()
        return x.withColumns({low: at["q1"], high: at["q3"]})

    reach = F.lit(k) * (F.col(high) - F.col(low))
    valid = col.isNull() | F.coalesce((col >= F.col(low) - reach) & (col <= F.col(high) + reach),
                                      F.lit(False))

    def build(get, total):
        ok = get(name)
        return {"passed_count": ok, "failed_records": total - ok,
                "details": _details(k=k, q1=get(f"{key}_lo"), q3=get(f"{key}_hi"))}

    return Check(rule, aggs={name: F.count_if(valid), f"{key}_lo": F.max(low),
                             f"{key}_hi": F.max(high)},
                 build=build, prep=prep, row_valid=valid, empty_rate=1.0)


# ------------------------------------------------------------------ Q12, Q13

def timeliness(df: DataFrame, rule: Rule, key: str, as_of) -> Check:
    c = rule.column or rule.definition.get("date_column")
    if not c or c not in df.columns:
        raise RuleError(f"Date column '{c}' not found")
    if as_of is None:
        raise RuleError("timeliness needs an explicit as_of")
    hours = float(rule.definition.get("max_age_hours", 24))
    valid = P.not_older_than(P.as_timestamp(_col(df, c), _dtype(df, c)), as_of, hours)
    return _row_rule(rule, key, valid, {"max_age_hours": hours, "as_of": str(as_of)})


def conformity(df: DataFrame, rule: Rule, key: str) -> Check:
    c = _require_column(df, rule, f"Column '{rule.column}' not found")
    d = rule.definition
    std = d.get("standard")
    col = _col(df, c).cast("string")
    if std == "ISO_8601_DATE":
        ok = P.iso_date(col)
    elif std == "EMAIL":
        ok = P.email_loose(col)
    elif d.get("pattern"):
        ok = col.rlike(d["pattern"])
    else:
        raise RuleError(f"unknown conformity standard: {std}")
    valid = _col(df, c).isNull() | F.coalesce(ok, F.lit(False))
    return _row_rule(rule, key, valid, {"standard": std or "pattern"})


# ------------------------------------------------------------------ Q14 / Q15 / J2

def reference_integrity(df: DataFrame, rule: Rule, key: str, frames: dict | None = None) -> Check:
    """J2/Q15 (engine), J2b/Q14 ``integrity`` (service: reference column
    defaults to ``id``, threshold 1.0) and Q8 referential consistency: one
    left join to the deduplicated (A23 DISTINCT) non-null reference keys;
    a NULL foreign key is valid."""
    d = rule.definition
    frames = frames or {}
    c = rule.column
    ref_name = d.get("reference_table")
    ref_col = d.get("reference_column") or ("id" if rule.rule_type == "integrity" else None)
    if not c or not ref_name or not ref_col:
        raise RuleError("a reference rule needs a column, a reference table and its column")
    if c not in df.columns:
        raise RuleError(f"Column {c} not found in dataset")
    ref = frames.get(ref_name) if isinstance(ref_name, str) else ref_name
    if ref is None:
        raise RuleError(f"reference table '{ref_name}' is not available")
    if ref_col not in ref.columns:
        raise RuleError(f"reference column '{ref_col}' not found")
    flag = f"{key}_hit"
    prep = lambda x: J.membership_flag(x, c, ref, ref_col, flag)
    valid = F.col(flag) | F.col(c).isNull()
    name = f"{key}_ok"

    def build(get, total):
        ok = get(name)
        return {"passed_count": ok, "failed_records": total - ok,
                "details": _details(reference_table=str(ref_name), reference_column=ref_col,
                                    valid_references=ok, invalid_references=total - ok)}

    return Check(rule, aggs={name: F.count_if(valid)}, build=build, prep=prep,
                 row_valid=valid, empty_rate=0.0 if rule.dialect == "engine" else 1.0)


# ------------------------------------------------------------------ Q16 / Q17

def range_check(df: DataFrame, rule: Rule, key: str) -> Check:
    c = _require_column(df, rule, f"Column {rule.column} not found in dataset")
    d = rule.definition
    lo, hi = d.get("min_value"), d.get("max_value")
    valid = P.in_range(_col(df, c), lo, hi)
    return _row_rule(rule, key, valid, {"min_value": lo, "max_value": hi}, empty_rate=0.0)


def regex_pattern(df: DataFrame, rule: Rule, key: str) -> Check:
    pattern = rule.definition.get("pattern")
    if not pattern:
        raise RuleError("the rule has no pattern")
    c = _require_column(df, rule, f"Column {rule.column} not found in dataset")
    valid = F.coalesce(P.match_start(_col(df, c).cast("string"), pattern), F.lit(False))
    return _row_rule(rule, key, valid, {"pattern": pattern}, empty_rate=0.0)


# ------------------------------------------------------------------ Q18

# Functions that run JVM code named by their arguments.
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


def custom_sql(df: DataFrame, rule: Rule, key: str, frames: dict) -> Check:
    """The query's frames are named by CTEs around it, and it stands in the
    place of a table, where no command can stand. Before anything is run its
    parsed plan is read: it may name only the supplied frames (and its own
    CTEs) and call no function that reaches into the JVM."""
    q = rule.definition.get("sql_query")
    if not q or not q.strip():
        raise RuleError("the rule has no SQL query")
    for k in frames:
        q = q.replace("{" + k + "}", f"`{k}`")
    spark = df.sparkSession
    counted = f"SELECT count(*) AS n_rows FROM (\n{q}\n)"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(counted).toString()
    except Exception as exc:  # noqa: BLE001 - a parse error of any kind
        raise RuleError(f"not a read-only query: {type(exc).__name__}") from None
    own = {n.strip() for m in re.findall(r"CTE \[([^\]]*)\]", plan) for n in m.split(",")}
    named = {n.strip() for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan)}
    foreign = {n for n in named if n not in own and n not in frames}
    if foreign:
        raise RuleError(f"not among the supplied frames: {sorted(foreign)}")
    called = {n.lower() for n in re.findall(r"(\w+)\(", plan)} & FORBIDDEN_FUNCTIONS
    if called:
        raise RuleError(f"functions that a rule can't call: {sorted(called)}")
    used = [k for k in frames if k in named]
    binds = ", ".join(f"`{k}` AS (SELECT * FROM {{__f{i}}})" for i, k in enumerate(used))
    text = counted.replace("{", "{{").replace("}", "}}")
    try:
        res = spark.sql(f"WITH {binds} {text}" if used else text.replace("{{", "{")
                        .replace("}}", "}"), **{f"__f{i}": frames[k] for i, k in enumerate(used)})
    except AnalysisException as exc:
        raise RuleError(f"the SQL query failed: {exc.getCondition()}") from None
    return Check(rule, sql_plan=res)


# Named, pre-registered row checks (pandas UDFs returning a boolean per
# row). Rules refer to them by name - no code is taken from rule data.
ROW_CHECKS: dict = {}


def register_row_check(name: str, udf) -> None:
    ROW_CHECKS[name] = udf


def python_check(df: DataFrame, rule: Rule, key: str) -> Check:
    c = _require_column(df, rule)
    name = rule.definition.get("check")
    if name not in ROW_CHECKS:
        raise RuleError(f"unknown registered check: {name}")
    valid = F.coalesce(ROW_CHECKS[name](_col(df, c)), F.lit(False))
    return _row_rule(rule, key, valid, {"check": name})


COMPILERS = {
    "python": lambda df, r, k, fr, a: python_check(df, r, k),
    "completeness": lambda df, r, k, fr, a: completeness(df, r, k),
    "uniqueness": lambda df, r, k, fr, a: uniqueness(df, r, k),
    "validity": lambda df, r, k, fr, a: validity(df, r, k),
    "consistency": lambda df, r, k, fr, a: (reference_integrity(df, r, k, fr)
                                            if r.definition.get("type") == "referential"
                                            else consistency(df, r, k)),
    "accuracy": lambda df, r, k, fr, a: accuracy(df, r, k, fr),
    "timeliness": lambda df, r, k, fr, a: timeliness(df, r, k, a),
    "conformity": lambda df, r, k, fr, a: conformity(df, r, k),
    "integrity": lambda df, r, k, fr, a: reference_integrity(df, r, k, fr),
    "reference_integrity": lambda df, r, k, fr, a: reference_integrity(df, r, k, fr),
    "range_check": lambda df, r, k, fr, a: range_check(df, r, k),
    "regex_pattern": lambda df, r, k, fr, a: regex_pattern(df, r, k),
    "custom_sql": lambda df, r, k, fr, a: custom_sql(df, r, k, fr),
}


def compile_rule(df: DataFrame, rule: Rule, key: str, frames: dict | None = None,
                 as_of=None) -> Check:
    """Q19: any planning error becomes an ``error`` check; others continue."""
    rule = rule.normalized()
    try:
        fn = COMPILERS.get(rule.rule_type)
        if fn is None:
            raise RuleError(f"Unsupported rule type: {rule.rule_type}")
        return fn(df, rule, key, frames or {}, as_of)
    except RuleError as exc:
        return Check(rule, error=str(exc))

