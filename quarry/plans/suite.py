"""Registered queries: each builds a Spark plan over the supplied tables and
has (where SQL can express it) an independent SQL text for the oracle.

Derived inputs (nulls, usage records, runs, quotas) follow FIXTURES.md part C.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import (access, catalog, lineage, monitoring, profile, remediate, runs,
                              sequence, transforms, usage)
from quarry.operators.quality import Rule, auto_rules, row_flags, run_rules
from quarry.sinks import merge_frames
from quarry.sources.introspect import infer_document_schema

AS_OF = "2024-01-31 00:00:00"
RESULT_COLS = ["rule_id", "status", "pass_rate", "failed_records", "total_records", "threshold"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def _ntz(*cols: str):
    """Report session-time timestamps as TIMESTAMP_NTZ, the type of the
    source columns (and of the SQL oracle's results)."""
    return lambda df: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def results(df: DataFrame) -> DataFrame:
    return df.select(*RESULT_COLS)


def rule_sql(rule_id: str, ok: str, total: str, thr: float, src: str,
             empty_rate: float = 0.0, failed: str | None = None) -> str:
    """Oracle text for one rule row: ``ok`` = passing-record count expression."""
    rate = f"CASE WHEN {total} > 0 THEN ({ok})::DOUBLE / ({total}) ELSE {empty_rate}::DOUBLE END"
    return (f"SELECT '{rule_id}' AS rule_id, CASE WHEN {total} = 0 THEN 'error' "
            f"WHEN {rate} >= {thr}::DOUBLE THEN 'passed' ELSE 'failed' END AS status, "
            f"{rate} AS pass_rate, ({failed or f'{total} - ({ok})'})::BIGINT AS failed_records, "
            f"({total})::BIGINT AS total_records, {thr}::DOUBLE AS threshold FROM {src}")


# =========================================================== quality rules

def _events_nulls(spark, d):
    return T(spark, d, "events").withColumn("event_type", F.expr("nullif(event_type, 'error')"))


EV_NULLS = ("(SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, value, "
            "props FROM events)")


@register("completeness_by_column", " UNION ALL ".join([
    rule_sql("c_event_type", "count(event_type)", "count(*)", 0.95, EV_NULLS),
    rule_sql("c_value", "count(value)", "count(*)", 0.95, EV_NULLS),
    rule_sql("c_props_notnull", "count(props)", "count(*)", 1.0, EV_NULLS),
]))
def q_completeness_by_column(spark, d):
    """A1/Q1/Q22 not_null alias, fused into one pass."""
    ev = _events_nulls(spark, d)
    rules = [Rule("c_event_type", "completeness", "event_type"),
             Rule("c_value", "completeness", "value"),
             Rule("c_props_notnull", "not_null", "props")]
    return results(run_rules(ev, rules))


@register("completeness_overall", f"""
SELECT 'c_all' AS rule_id,
       CASE WHEN n = 0 THEN 'error' WHEN nn::DOUBLE / (n * 6) >= 0.95 THEN 'passed'
            ELSE 'failed' END AS status,
       CASE WHEN n > 0 THEN nn::DOUBLE / (n * 6) ELSE 0.0 END AS pass_rate,
       (n * 6 - nn)::BIGINT AS failed_records, n::BIGINT AS total_records,
       0.95::DOUBLE AS threshold
FROM (SELECT count(*) AS n, count(event_id) + count(ts) + count(user_id) + count(event_type)
             + count(value) + count(props) AS nn FROM {EV_NULLS})""")
def q_completeness_overall(spark, d):
    """A2: whole-table completeness (no column given)."""
    return results(run_rules(_events_nulls(spark, d), [Rule("c_all", "completeness", None)]))


@register("uniqueness_rules", " UNION ALL ".join([
    rule_sql("u_orderkey", "count(DISTINCT l_orderkey)", "count(*)", 1.0, "lineitem", 1.0),
    rule_sql("u_order_line", "(SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber "
             "FROM lineitem))", "count(*)", 1.0, "lineitem", 1.0),
    rule_sql("u_priority_nulls", "count(DISTINCT pr) + max(CASE WHEN pr IS NULL THEN 1 ELSE 0 END)",
             "count(*)", 1.0, "(SELECT nullif(o_orderpriority, '5-LOW') AS pr FROM orders)", 1.0),
    rule_sql("u_priority", "count(DISTINCT pr)", "count(*)", 1.0,
             "(SELECT nullif(o_orderpriority, '5-LOW') AS pr FROM orders)", 1.0),
]))
def q_uniqueness(spark, d):
    """A3 single column (nulls excluded), A4 composite (nulls equal), A5
    null-counted; Q2. Two datasets -> two fused passes."""
    li = T(spark, d, "lineitem")
    od = T(spark, d, "orders").withColumn("pr", F.expr("nullif(o_orderpriority, '5-LOW')"))
    a = run_rules(li, [Rule("u_orderkey", "uniqueness", "l_orderkey"),
                       Rule("u_order_line", "unique", None,
                            {"columns": ["l_orderkey", "l_linenumber"]})])
    b = run_rules(od, [Rule("u_priority_nulls", "uniqueness", "pr", {"null_policy": "count"}),
                       Rule("u_priority", "uniqueness", "pr")])
    return results(a).unionByName(results(b))


PART_VALIDITY = [
    Rule("v_name", "validity", "p_name", {"pattern": "(small|large|red|blue)"}),
    Rule("v_size", "validity", "p_size", {"range": {"min": 5, "max": 45}}),
    Rule("v_brand", "validity", "p_brand",
         {"allowed_values": [f"Brand#{i}" for i in range(1, 21)], "threshold": 0.9}),
    Rule("v_price_float", "validity", "price_text", {"data_type": "float", "threshold": 0.95}),
    Rule("v_name_int", "validity", "p_name", {"data_type": "int"}),
]


@register("validity_rules", " UNION ALL ".join([
    rule_sql("v_name", "count_if(p_name IS NULL OR regexp_matches(p_name, '^(?:(small|large|red|blue))'))",
             "count(*)", 1.0, "part", 1.0),
    rule_sql("v_size", "count_if(p_size IS NULL OR (p_size >= 5 AND p_size <= 45))", "count(*)",
             1.0, "part", 1.0),
    rule_sql("v_brand", "count_if(p_brand IS NULL OR p_brand IN (" +
             ", ".join(f"'Brand#{i}'" for i in range(1, 21)) + "))", "count(*)", 0.9, "part", 1.0),
    rule_sql("v_price_float", "count_if(p_partkey % 7 <> 0)", "count(*)", 0.95, "part", 1.0),
    rule_sql("v_name_int", "count_if(p_name IS NULL OR regexp_matches(p_name, '^\\s*[+-]?\\d+\\s*$'))",
             "count(*)", 1.0, "part", 1.0),
]))
def q_validity_rules(spark, d):
    """Q3: pattern (start-anchored), range, allowed values, castability
    (every seventh price text is no number)."""
    part = T(spark, d, "part").withColumn("price_text", F.concat(
        F.when(F.col("p_partkey") % 7 == 0, "about ").otherwise(""),
        F.col("p_retailprice").cast("string")))
    return results(run_rules(part, PART_VALIDITY))


@register("validity_reasons", """
SELECT reason, count(*) AS n FROM (
  SELECT 'Pattern mismatch: (small|large|red|blue)' AS reason FROM part
    WHERE p_name IS NOT NULL AND NOT regexp_matches(p_name, '^(?:(small|large|red|blue))')
  UNION ALL SELECT 'Below minimum: 5' FROM part WHERE p_size < 5
  UNION ALL SELECT 'Above maximum: 45' FROM part WHERE p_size > 45
) GROUP BY reason""")
def q_validity_reasons(spark, d):
    """Q3 per-row reasons array (one row-level pass), counted per reason."""
    rule = Rule("v_multi", "validity", "p_name", {"pattern": "(small|large|red|blue)"})
    rule2 = Rule("v_size", "validity", "p_size", {"range": {"min": 5, "max": 45}})
    flagged = row_flags(T(spark, d, "part"), [rule, rule2])
    return (flagged.select(F.explode("_reasons").alias("r"))
            .select(F.explode(F.split("r", "; ")).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@register("engine_validity", " UNION ALL ".join([
    rule_sql("e_int", "count_if(l_orderkey % 10 NOT IN (0, 1))", "count(*)", 0.95, "lineitem"),
    rule_sql("e_string", "count(l_returnflag)", "count(*)", 0.95, "lineitem"),
    rule_sql("e_datetime", "count(l_shipdate)", "count(*)", 0.95, "lineitem"),
    rule_sql("e_email", "count_if(regexp_matches(l_returnflag, "
             "'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$'))", "count(*)", 0.95, "lineitem"),
]))
def q_engine_validity(spark, d):
    """Q4: engine-dialect type validity (integer/string/datetime/email)."""
    ten = F.col("l_orderkey") % 10     # every tenth key is no number, every tenth is null
    li = T(spark, d, "lineitem").withColumn("key_text", F.when(ten != 1, F.concat(
        F.when(ten == 0, "k").otherwise(""), F.col("l_orderkey").cast("string"))))
    rules = [Rule("e_int", "validity", "key_text", {"expected_type": "integer"}, dialect="engine"),
             Rule("e_string", "validity", "l_returnflag", {"expected_type": "string"},
                  dialect="engine"),
             Rule("e_datetime", "validity", "l_shipdate", {"expected_type": "datetime"},
                  dialect="engine"),
             Rule("e_email", "validity", "l_returnflag", {"expected_type": "email"},
                  dialect="engine")]
    return results(run_rules(li, rules))


OL = ("(SELECT o.o_orderkey, o.o_orderdate, l.l_shipdate, l.l_extendedprice, l.l_quantity, "
      "l.l_discount FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey)")


@register("consistency_rules", " UNION ALL ".join([
    rule_sql("k_cross", "count_if(coalesce(l_extendedprice >= l_quantity * 900, false))",
             "count(*)", 1.0, OL, 1.0),
    rule_sql("k_engine", "count_if(coalesce(l_extendedprice > l_quantity, false))", "count(*)",
             0.95, OL),
    rule_sql("k_temporal", "count_if(o_orderdate IS NULL OR l_shipdate IS NULL OR "
             "o_orderdate <= l_shipdate)", "count(*)", 1.0, OL, 1.0),
]))
def q_consistency(spark, d):
    """Q5 cross-column condition, Q6 column1/column2 placeholders, Q7
    temporal order over orders joined to line items (one fused pass)."""
    o, li = T(spark, d, "orders"), T(spark, d, "lineitem")
    ol = o.join(li, o.o_orderkey == li.l_orderkey).select(
        "o_orderkey", "o_orderdate", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    rules = [Rule("k_cross", "consistency", None,
                  {"condition": "l_extendedprice >= l_quantity * 900"}),
             Rule("k_engine", "consistency", None,
                  {"column1": "l_extendedprice", "column2": "l_quantity",
                   "rule": "column1 > column2"}, dialect="engine"),
             Rule("k_temporal", "consistency", None,
                  {"type": "temporal", "date_columns": ["o_orderdate", "l_shipdate"]})]
    return results(run_rules(ol, rules))


@register("reference_integrity", " UNION ALL ".join([
    rule_sql("ri_orders", "count_if(o_orderkey IS NULL OR o_orderkey IN "
             "(SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL))", "count(*)", 0.95,
             "orders"),
    rule_sql("ri_cust", "count_if(o_custkey IS NULL OR o_custkey IN "
             "(SELECT c_custkey FROM customer))", "count(*)", 1.0, "orders", 1.0),
]))
def q_reference_integrity(spark, d):
    """J2/Q15 (engine) and Q14 integrity (service) in one pass: one left
    join per reference table to its deduplicated key set."""
    od, li, cu = T(spark, d, "orders"), T(spark, d, "lineitem"), T(spark, d, "customer")
    rules = [Rule("ri_orders", "reference_integrity", "o_orderkey",
                  {"reference_table": "lineitem", "reference_column": "l_orderkey"},
                  dialect="engine"),
             Rule("ri_cust", "integrity", "o_custkey",
                  {"reference_table": "customer", "reference_column": "c_custkey"})]
    return results(run_rules(od, rules, frames={"lineitem": li, "customer": cu}))


@register("orphan_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o
WHERE o_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def q_orphan_rows(spark, d):
    """J2 bad rows: orders without line items (left anti join)."""
    from quarry.operators.joins import orphans

    return orphans(T(spark, d, "orders"), "o_orderkey", T(spark, d, "lineitem"),
                   "l_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


LP = ("(SELECT l.l_partkey, round(l.l_extendedprice / l.l_quantity, 2) AS unit_price "
      "FROM lineitem l)")


@register("accuracy_vs_reference", rule_sql(
    "acc_price", "count_if(p.pk IS NOT NULL AND lp.unit_price IS NOT DISTINCT FROM p.rp)",
    "count(*)", 0.9, f"{LP} lp LEFT JOIN (SELECT p_partkey AS pk, max(p_retailprice) AS rp "
    "FROM part GROUP BY p_partkey) p ON lp.l_partkey = p.pk", 1.0))
def q_accuracy(spark, d):
    """Line-item unit price vs the part's retail price by key
    (null-safe equality; unmatched keys are inaccurate)."""
    li = T(spark, d, "lineitem").select(
        "l_partkey", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"))
    rule = Rule("acc_price", "accuracy", "unit_price",
                {"reference_source": "part", "reference_column": "p_retailprice",
                 "keys": ["l_partkey"], "reference_keys": ["p_partkey"]})
    return results(run_rules(li, [rule], frames={"part": T(spark, d, "part")}))


@register("timeliness", rule_sql(
    "t_events", "count_if(ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 72 HOUR)", "count(*)",
    0.9, "events", 1.0))
def q_timeliness(spark, d):
    """Q12/F13 with a fixed clock."""
    return results(run_rules(T(spark, d, "events"),
                             [Rule("t_events", "timeliness", "ts", {"max_age_hours": 72})],
                             as_of=AS_OF))


TOKENS = ("(SELECT t AS token FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS t "
          "FROM documents) WHERE t LIKE '%@%')")
DATES = ("(SELECT CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') "
         "ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d FROM orders)")


@register("conformity", " UNION ALL ".join([
    rule_sql("cf_email", "count_if(token IS NULL OR regexp_matches(token, '^[^@]+@[^@]+\\.[^@]+$'))",
             "count(*)", 1.0, TOKENS, 1.0),
    rule_sql("cf_iso", "count_if(d IS NULL OR (regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') AND "
             "try_strptime(d, '%Y-%m-%d') IS NOT NULL))", "count(*)", 1.0, DATES, 1.0),
]))
def q_conformity(spark, d):
    """Q13: EMAIL over '@' tokens of every document (whole texts), and
    ISO_8601_DATE over order dates rendered in two formats."""
    tokens = (T(spark, d, "documents")
              .select(F.explode(F.split("text", r"\s+")).alias("token"))
              .where(F.col("token").contains("@")))
    dates = T(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"))
    a = run_rules(tokens, [Rule("cf_email", "conformity", "token", {"standard": "EMAIL"})])
    b = run_rules(dates, [Rule("cf_iso", "conformity", "d", {"standard": "ISO_8601_DATE"})])
    return results(a).unionByName(results(b))


@register("statistical_accuracy", rule_sql(
    "z_value", "count_if(value IS NULL OR abs(value - s.m) <= 3 * s.sd)", "count(*)", 0.9,
    "events, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events) s", 1.0))
def q_statistical(spark, d):
    """Q11: share of values within 3 standard deviations of the mean."""
    return results(run_rules(T(spark, d, "events"),
                             [Rule("z_value", "accuracy", "value", {"method": "statistical"})]))


@register("custom_sql_rules", """
SELECT 'sql_neg' AS rule_id, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status,
       CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS pass_rate, n AS failed_records, n AS total_records,
       1.0::DOUBLE AS threshold
FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity <= 0)
UNION ALL
SELECT 'sql_late', CASE WHEN n > 0 THEN 'passed' ELSE 'failed' END,
       (CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, n, n, 1.0::DOUBLE
FROM (SELECT count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
      WHERE l.l_shipdate < o.o_orderdate)""")
def q_custom_sql(spark, d):
    """Q18: read-only SQL rules over the tenant's frames (expected pass/fail)."""
    frames = {"lineitem": T(spark, d, "lineitem"), "orders": T(spark, d, "orders")}
    rules = [Rule("sql_neg", "custom_sql", None,
                  {"sql_query": "SELECT * FROM {lineitem} WHERE l_quantity <= 0"}),
             Rule("sql_late", "custom_sql", None,
                  {"sql_query": "SELECT * FROM {orders} o JOIN {lineitem} l "
                                "ON o.o_orderkey = l.l_orderkey WHERE l.l_shipdate < o.o_orderdate",
                   "expected_result": "fail"})]
    return results(run_rules(frames["lineitem"], rules, frames=frames))


@register("range_regex_rules", " UNION ALL ".join([
    rule_sql("rg_discount", "count_if(l_discount IS NULL OR (l_discount >= 0 AND "
             "l_discount <= 0.08))", "count(*)", 0.95, "lineitem"),
    rule_sql("rx_flag", "count_if(coalesce(regexp_matches(l_returnflag, '^(?:[AR])'), false))",
             "count(*)", 0.95, "lineitem"),
]))
def q_range_regex(spark, d):
    """Q16 range_check (nulls valid) and Q17 regex_pattern (nulls invalid)."""
    return results(run_rules(T(spark, d, "lineitem"), [
        Rule("rg_discount", "range", "l_discount", {"min_value": 0, "max_value": 0.08}),
        Rule("rx_flag", "format", "l_returnflag", {"pattern": "[AR]"})]))


@register("rule_errors", """
SELECT 'err_missing' AS rule_id, 'error' AS status, count(*)::BIGINT AS total_records FROM customer
UNION ALL SELECT 'err_no_pattern', 'error', count(*)::BIGINT FROM customer
UNION ALL SELECT 'err_bad_condition', 'error', count(*)::BIGINT FROM customer
UNION ALL SELECT 'ok_balance', CASE WHEN count_if(c_acctbal IS NULL OR c_acctbal >= -1000)::DOUBLE
  / count(*) >= 0.95 THEN 'passed' ELSE 'failed' END, count(*)::BIGINT FROM customer""")
def q_rule_errors(spark, d):
    """Q19: planning errors isolate to their own rule (status error)."""
    rules = [Rule("err_missing", "completeness", "no_such_column", dialect="engine"),
             Rule("err_no_pattern", "regex_pattern", "c_name"),
             Rule("err_bad_condition", "consistency", None, {"condition": "no_such > 1"}),
             Rule("ok_balance", "range_check", "c_acctbal", {"min_value": -1000})]
    return run_rules(T(spark, d, "customer"), rules).select("rule_id", "status", "total_records")


@register("auto_check_summary", """
WITH r AS (
  SELECT count(event_id) = count(*) AS a, count(ts) = count(*) AS b, count(user_id) = count(*) AS c,
         count(event_type) = count(*) AS d1, count(value) = count(*) AS e, count(props) = count(*) AS f,
         count(DISTINCT event_id) = count(*) AS g, count(DISTINCT user_id) = count(*) AS h
  FROM (SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, value, props FROM events))
SELECT 8::BIGINT AS total_checks,
       (a::INT + b::INT + c::INT + d1::INT + e::INT + f::INT + g::INT + h::INT)::BIGINT AS passed_checks,
       (a::INT + b::INT + c::INT + d1::INT + e::INT + f::INT + g::INT + h::INT) / 8.0 AS success_rate
FROM r""")
def q_auto_check(spark, d):
    """Completeness (threshold 1.0) on every column, uniqueness on the
    columns whose name contains 'id'; one fused pass, then the summary."""
    ev = _events_nulls(spark, d)
    res = run_rules(ev, auto_rules(ev.columns, completeness_threshold=1.0))
    return (res.agg(F.count(F.lit(1)).alias("total_checks"),
                    F.count_if(F.col("status") == "passed").alias("passed_checks"))
            .withColumn("success_rate", F.col("passed_checks") / F.col("total_checks")))


@register("grouped_quality_daily", """
WITH e AS (SELECT date_trunc('day', ts) AS day, nullif(event_type, 'error') AS event_type, value
           FROM events)
SELECT day, 'g_type' AS rule_id, count(event_type)::DOUBLE / count(*) AS pass_rate,
       (count(*) - count(event_type))::BIGINT AS failed_records, count(*)::BIGINT AS total_records
FROM e GROUP BY day
UNION ALL
SELECT day, 'g_value', count_if(value IS NULL OR (value >= 0 AND value <= 150))::DOUBLE / count(*),
       (count(*) - count_if(value IS NULL OR (value >= 0 AND value <= 150)))::BIGINT, count(*)::BIGINT
FROM e GROUP BY day""")
def q_grouped_daily(spark, d):
    """Rules evaluated per partition (day) in one grouped aggregation."""
    ev = _events_nulls(spark, d).withColumn("day", F.date_trunc("DAY", "ts"))
    res = run_rules(ev, [Rule("g_type", "completeness", "event_type"),
                         Rule("g_value", "range_check", "value",
                              {"min_value": 0, "max_value": 150})], group_by=["day"])
    return res.select(F.col("day").cast("timestamp_ntz").alias("day"), "rule_id", "pass_rate",
                      "failed_records", "total_records")


@register("quality_report", """
WITH e AS (SELECT date_trunc('day', ts) AS day, nullif(event_type, 'error') AS event_type, value
           FROM events),
r AS (
  SELECT day, CASE WHEN count(event_type)::DOUBLE / count(*) >= 0.95 THEN 'passed' ELSE 'failed' END AS status
  FROM e GROUP BY day
  UNION ALL
  SELECT day, CASE WHEN count_if(value IS NULL OR (value >= 0 AND value <= 150))::DOUBLE / count(*) >= 0.95
              THEN 'passed' ELSE 'failed' END FROM e GROUP BY day)
SELECT date_trunc('week', day) AS period_start, count(*)::BIGINT AS total_rules,
       count_if(status = 'passed')::BIGINT AS passed, count_if(status = 'failed')::BIGINT AS failed,
       count_if(status = 'passed')::DOUBLE / count(*) AS score
FROM r GROUP BY 1""")
def q_quality_report(spark, d):
    """Weekly report over daily grouped rule results."""
    ev = _events_nulls(spark, d).withColumn("day", F.date_trunc("DAY", "ts"))
    res = run_rules(ev, [Rule("g_type", "completeness", "event_type"),
                         Rule("g_value", "range_check", "value",
                              {"min_value": 0, "max_value": 150})], group_by=["day"])
    rep = monitoring.quality_report(res.withColumn("executed_at", F.col("day"))
                                    .withColumn("dataset_name", F.lit("events")), "weekly")
    return rep.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"),
                      "total_rules", "passed", "failed", "score")


# =========================================================== remediation

LI_RULES = [Rule("rg_discount", "range_check", "l_discount", {"min_value": 0, "max_value": 0.08}),
            Rule("rx_flag", "regex_pattern", "l_returnflag", {"pattern": "[AR]"}),
            Rule("u_line", "uniqueness", None, {"columns": ["l_orderkey", "l_linenumber"]})]


@register("quarantine_split", """
WITH f AS (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem),
g AS (
  SELECT concat_ws(',',
           CASE WHEN NOT (l_discount IS NULL OR (l_discount >= 0 AND l_discount <= 0.08)) THEN 'rg_discount' END,
           CASE WHEN NOT coalesce(regexp_matches(l_returnflag, '^(?:[AR])'), false) THEN 'rx_flag' END,
           CASE WHEN n > 1 THEN 'u_line' END) AS failed_rules
  FROM f)
SELECT CASE WHEN failed_rules = '' THEN 'good' ELSE 'bad' END AS part, failed_rules,
       count(*) AS n FROM g GROUP BY ALL""")
def q_quarantine(spark, d):
    """R2: good/bad split with failed rule ids (good ∪ bad = input), counted
    from one flagged pass (the split itself is ``remediate.split_write``)."""
    flagged = row_flags(T(spark, d, "lineitem"), LI_RULES)
    fr = F.array_join("_failed_rules", ",")
    return (flagged.groupBy(fr.alias("failed_rules")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.when(F.col("failed_rules") == "", "good").otherwise("bad").alias("part"),
                    "failed_rules", "n"))


@register("autofix_clamp", """
SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_discount, 0), 0.08) AS l_discount,
       CASE WHEN regexp_matches(l_returnflag, '^(?:[AR])') THEN l_returnflag END AS l_returnflag
FROM lineitem""")
def q_autofix(spark, d):
    """Clamp out-of-range values, null-out pattern failures."""
    fixed = remediate.auto_fix(T(spark, d, "lineitem"),
                               [r for r in LI_RULES if r.rule_type != "uniqueness"])
    return fixed.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag")


@register("dedupe_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)
WHERE rn = 1""")
def q_dedupe(spark, d):
    """Keep the first row per key under an explicit order."""
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                        "l_shipdate", "l_extendedprice", "l_quantity")
    out = remediate.dedupe_keep_first(li, ["l_orderkey", "l_linenumber"],
                                      [F.col("l_shipdate"), F.col("l_partkey"),
                                       F.col("l_suppkey"), F.col("l_extendedprice"),
                                       F.col("l_quantity")])
    return out.drop("l_quantity")


@register("incidents_and_alerts", """
WITH r AS (
  SELECT 'rg_discount' AS rule_id, 'range_check' AS rule_type, 'high' AS severity,
         count_if(NOT (l_discount IS NULL OR (l_discount >= 0 AND l_discount <= 0.08))) AS failed,
         count_if(l_discount IS NULL OR (l_discount >= 0 AND l_discount <= 0.08))::DOUBLE / count(*) AS rate,
         0.95 AS thr, 'manual_review' AS action FROM lineitem
  UNION ALL
  SELECT 'rx_flag', 'regex_pattern', 'low',
         count_if(NOT coalesce(regexp_matches(l_returnflag, '^(?:[AR])'), false)),
         count_if(coalesce(regexp_matches(l_returnflag, '^(?:[AR])'), false))::DOUBLE / count(*),
         0.95, 'alert_only' FROM lineitem)
SELECT action, rule_id, 'Quality Rule Failure: ' || rule_type AS incident_type, severity,
       failed::BIGINT AS affected_records
FROM r WHERE rate < thr""")
def q_incidents(spark, d):
    """Failed results routed by the rule's remediation action."""
    rules = [Rule("rg_discount", "range_check", "l_discount", {"min_value": 0, "max_value": 0.08},
                  severity="high", remediation="manual_review"),
             Rule("rx_flag", "regex_pattern", "l_returnflag", {"pattern": "[AR]"},
                  severity="low", remediation="alert_only")]
    res = run_rules(T(spark, d, "lineitem"), rules)
    rules_df = spark.createDataFrame([(r.rule_id, r.remediation) for r in rules],
                                     "id string, remediation_action string")
    routed = remediate.route(res, rules_df)
    inc = remediate.incidents(routed).select(
        F.lit("manual_review").alias("action"), "rule_id", "incident_type", "severity",
        "affected_records")
    al = routed.where(F.col("action") == "alert_only").select(
        "action", "rule_id", F.concat(F.lit("Quality Rule Failure: "), "rule_type")
        .alias("incident_type"), "severity", F.col("failed_records").alias("affected_records"))
    return inc.unionByName(al)


# =========================================================== pipeline & transforms

ORDER_CHAIN = [
    {"type": "filter", "condition": "o_totalprice > 0"},
    {"type": "add_column", "name": "order_year", "expression": "year(o_orderdate)"},
    {"type": "aggregate", "group_by": ["o_custkey"],
     "aggregations": {"total_spent": "round(sum(o_totalprice), 2)", "n_orders": "count(*)",
                      "last_year": "max(order_year)"}},
]
CHAIN_SQL = ("(SELECT o_custkey, round(sum(o_totalprice), 2) AS total_spent, count(*) AS n_orders, "
             "max(year(o_orderdate))::INTEGER AS last_year FROM orders WHERE o_totalprice > 0 "
             "GROUP BY o_custkey)")
FLAGSHIP_RULES = [Rule("fq_spent", "completeness", "total_spent"),
                  Rule("fq_unique", "uniqueness", "o_custkey"),
                  Rule("fq_orders", "range_check", "n_orders", {"min_value": 1, "max_value": 15})]


@register("transform_chain_quality", " UNION ALL ".join([
    rule_sql("fq_spent", "count(total_spent)", "count(*)", 0.95, CHAIN_SQL),
    rule_sql("fq_unique", "count(DISTINCT o_custkey)", "count(*)", 1.0, CHAIN_SQL, 1.0),
    rule_sql("fq_orders", "count_if(n_orders IS NULL OR (n_orders >= 1 AND n_orders <= 15))",
             "count(*)", 0.95, CHAIN_SQL),
]))
def q_transform_chain_quality(spark, d):
    """Flagship (7.2 step 1): parquet scan -> transform chain (filter,
    computed column, aggregate) -> fused completeness/uniqueness/range."""
    from quarry.plans.runner import PipelineSpec, quality_of

    spec = PipelineSpec(source={"format": "parquet", "path": os.path.join(d, "orders.parquet")},
                        transforms=ORDER_CHAIN, rules=FLAGSHIP_RULES)
    return results(quality_of(spark, spec))


@register("transform_chain", f"SELECT * FROM {CHAIN_SQL}")
def q_transform_chain(spark, d):
    """P1-P7 chain output (the transformed frame itself)."""
    return transforms.apply_transforms(T(spark, d, "orders"), ORDER_CHAIN)


@register("transform_select_rename", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice * 1.1 AS gross
FROM orders WHERE o_orderstatus = 'F'""")
def q_select_rename(spark, d):
    """P1 filter, P4 computed column, P2 select, P3 rename as a chain."""
    return transforms.apply_transforms(T(spark, d, "orders"), [
        {"type": "filter", "condition": "o_orderstatus = 'F'"},
        {"type": "add_column", "name": "gross", "expression": "o_totalprice * 1.1"},
        {"type": "select", "columns": ["o_orderkey", "o_custkey", "gross"]},
        {"type": "rename", "mapping": {"o_orderkey": "order_id", "o_custkey": "customer_id"}}])


@register("custom_sql_transform", """
SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price
FROM orders GROUP BY o_orderstatus""")
def q_custom_sql_transform(spark, d):
    """Free SQL over the incoming frame (bound as a DataFrame argument)."""
    return transforms.custom_sql(
        T(spark, d, "orders"),
        "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price "
        "FROM source GROUP BY o_orderstatus")


@register("param_sql", """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'
GROUP BY o_orderpriority""")
def q_param_sql(spark, d):
    """P9: '${x}' placeholders bound as typed named parameters."""
    import datetime as dt

    return transforms.parameterized_sql(
        spark, "SELECT o_orderpriority, count(*) AS n FROM {orders} "
               "WHERE o_orderdate >= '${start_date}' AND o_orderdate < '${end_date}' "
               "GROUP BY o_orderpriority",
        {"start_date": dt.date(1997, 1, 1), "end_date": dt.date(1998, 1, 1)},
        orders=T(spark, d, "orders"))


@register("incremental_load", """
SELECT 'orders' AS source, 'o_orderdate' AS "column", max(o_orderdate)::VARCHAR AS last_value,
       count(*) AS n_new
FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-30 00:00:00'""")
def q_incremental(spark, d):
    """P11 strict incremental filter + P12 new high-water mark, one pass."""
    import datetime as dt

    new = transforms.incremental_filter(T(spark, d, "orders"), "o_orderdate",
                                        dt.datetime(1999, 6, 30))
    return new.agg(F.max("o_orderdate").cast("string").alias("last_value"),
                   F.count(F.lit(1)).alias("n_new")).select(
        F.lit("orders").alias("source"), F.lit("o_orderdate").alias("column"),
        "last_value", "n_new")


@register("merge_upsert", """
WITH tgt AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
             WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00'),
src AS (SELECT o_orderkey, 'F' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders
        WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00')
SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)
UNION ALL SELECT * FROM src""")
def q_merge(spark, d):
    """K7: upsert of a changed slice into the older slice (anti join +
    union; last source row per key wins)."""
    o = T(spark, d, "orders")
    tgt = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_orderstatus", "o_totalprice")
    src = o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", F.lit("F").alias("o_orderstatus"),
        (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderdate")
    merged = merge_frames(tgt, src, ["o_orderkey"], order=[F.col("o_orderdate")])
    return merged.select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("duplicate_rows", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_duplicates(spark, d):
    """Q26: keys occurring more than once (partial aggregate, no window)."""
    return remediate.duplicate_keys(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# =========================================================== usage & quotas

USAGE_SQL = ("(SELECT 'org_' || (user_id % 3)::VARCHAR AS organization_id, event_type AS resource_type, "
             "value AS amount, ts, props, event_id FROM events)")
QUOTAS = [(f"org_{o}", r, float(lim), 0.8, per)
          for o in range(3)
          for r, lim, per in (("click", 150, "hourly"), ("view", 1000, "daily"),
                              ("purchase", 7000, "weekly"), ("signup", 30000, "monthly"),
                              ("error", 0, "monthly"))]
QUOTAS_SQL = ("(SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}', {c}::DOUBLE, {e}::DOUBLE, '{p}')" for a, b, c, e, p in QUOTAS) +
    ") q(organization_id, resource_type, quota_limit, warning_threshold, reset_period))")


def _quotas(spark):
    return spark.createDataFrame(QUOTAS, "organization_id string, resource_type string, "
                                         "quota_limit double, warning_threshold double, "
                                         "reset_period string")


@register("usage_rollup", f"""
SELECT organization_id, resource_type, round(sum(amount), 4) AS total_amount,
       count(*) AS record_count,
       arg_max(json_extract_string(props, '$.k'), {{'t': ts, 'i': event_id}}) AS meta_k
FROM {USAGE_SQL} GROUP BY ALL""")
def q_usage_rollup(spark, d):
    """Batch roll-up with last-wins metadata merge."""
    u = usage.usage_from_events(T(spark, d, "events")).withColumn(
        "meta", F.from_json("props", "map<string,string>"))
    out = usage.rollup_batch(u, "meta")
    return out.select("organization_id", "resource_type",
                      F.round("total_amount", 4).alias("total_amount"), "record_count",
                      F.col("metadata")["k"].alias("meta_k"))


@register("usage_per_period", f"""
SELECT organization_id, resource_type, date_trunc('day', ts) AS period_start,
       date_trunc('day', ts) + INTERVAL 1 DAY AS period_end, round(sum(amount), 4) AS usage,
       count(*) AS records
FROM {USAGE_SQL} GROUP BY ALL""")
def q_usage_per_period(spark, d):
    """Usage accumulated per daily period [start, end)."""
    out = usage.usage_per_period(usage.usage_from_events(T(spark, d, "events")), "daily")
    return out.withColumn("usage", F.round("usage", 4)).transform(_ntz("period_start", "period_end"))


@register("period_bounds", f"""
SELECT 'weekly' AS period, date_trunc('week', ts) AS period_start,
       date_trunc('week', ts) + INTERVAL 7 DAY AS period_end, count(*) AS n FROM events GROUP BY 2, 3
UNION ALL
SELECT 'monthly', date_trunc('month', ts), date_trunc('month', ts) + INTERVAL 1 MONTH, count(*)
FROM events GROUP BY 2, 3
UNION ALL
SELECT 'hourly', date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 1 HOUR, count(*)
FROM events GROUP BY 2, 3""")
def q_period_bounds(spark, d):
    """hourly / weekly (Monday) / monthly period bounds of every event."""
    from quarry.functions.periods import period_end, period_start

    ev = T(spark, d, "events")
    outs = []
    for p in ("weekly", "monthly", "hourly"):
        s = period_start(F.col("ts"), p)
        outs.append(ev.groupBy(s.alias("period_start"))
                    .agg(F.count(F.lit(1)).alias("n"))
                    .select(F.lit(p).alias("period"), "period_start",
                            period_end(F.col("period_start"), p).alias("period_end"), "n"))
    return outs[0].unionByName(outs[1]).unionByName(outs[2]).transform(
        _ntz("period_start", "period_end"))


QSTATUS_SQL = f"""
WITH q AS {QUOTAS_SQL},
u AS (
  SELECT u.organization_id, u.resource_type,
         CASE q.reset_period WHEN 'hourly' THEN date_trunc('hour', u.ts)
              WHEN 'daily' THEN date_trunc('day', u.ts) WHEN 'weekly' THEN date_trunc('week', u.ts)
              ELSE date_trunc('month', u.ts) END AS period_start,
         sum(u.amount) AS current_usage
  FROM {USAGE_SQL} u JOIN q USING (organization_id, resource_type) GROUP BY ALL),
s AS (
  SELECT u.*, q.quota_limit, q.warning_threshold, q.reset_period,
         CASE WHEN q.quota_limit > 0 THEN u.current_usage / q.quota_limit ELSE 0.0 END AS pct
  FROM u JOIN q USING (organization_id, resource_type))
SELECT organization_id, resource_type, period_start, round(current_usage, 4) AS current_usage,
       round(pct, 6) AS usage_percentage,
       CASE WHEN pct >= 1.0 THEN 'exceeded' WHEN pct >= warning_threshold THEN 'warning'
            ELSE 'active' END AS status,
       CASE reset_period WHEN 'hourly' THEN period_start + INTERVAL 1 HOUR
            WHEN 'daily' THEN period_start + INTERVAL 1 DAY
            WHEN 'weekly' THEN period_start + INTERVAL 7 DAY
            ELSE period_start + INTERVAL 1 MONTH END AS next_reset
FROM s"""


@register("quota_status", QSTATUS_SQL)
def q_quota_status(spark, d):
    """Usage bucketed by each quota's own reset period vs its limit."""
    st = usage.quota_status(_quotas(spark), usage.usage_from_events(T(spark, d, "events")))
    return st.select("organization_id", "resource_type", "period_start",
                     F.round("current_usage", 4).alias("current_usage"),
                     F.round("usage_percentage", 6).alias("usage_percentage"), "status",
                     "next_reset").transform(_ntz("period_start", "next_reset"))


@register("quota_violations", f"""
SELECT organization_id, resource_type, status AS violation_type, period_start,
       CASE WHEN status = 'exceeded' THEN 'alert_only' ELSE 'warning_sent' END AS action_taken
FROM ({QSTATUS_SQL}) WHERE status IN ('exceeded', 'warning')""")
def q_quota_violations(spark, d):
    """Violations and the enforcement action."""
    st = usage.quota_status(_quotas(spark), usage.usage_from_events(T(spark, d, "events")))
    return usage.violations(st).select("organization_id", "resource_type", "violation_type",
                                       "period_start", "action_taken").transform(_ntz("period_start"))


@register("quota_current", f"""
WITH q AS {QUOTAS_SQL},
b AS (SELECT q.*, CASE reset_period WHEN 'hourly' THEN date_trunc('hour', TIMESTAMP '2024-01-30 12:30:00')
        WHEN 'daily' THEN date_trunc('day', TIMESTAMP '2024-01-30 12:30:00')
        WHEN 'weekly' THEN date_trunc('week', TIMESTAMP '2024-01-30 12:30:00')
        ELSE date_trunc('month', TIMESTAMP '2024-01-30 12:30:00') END AS period_start FROM q),
u AS (SELECT b.organization_id, b.resource_type, sum(e.amount) AS cu FROM b JOIN {USAGE_SQL} e
      ON e.organization_id = b.organization_id AND e.resource_type = b.resource_type
      AND CASE b.reset_period WHEN 'hourly' THEN date_trunc('hour', e.ts)
        WHEN 'daily' THEN date_trunc('day', e.ts) WHEN 'weekly' THEN date_trunc('week', e.ts)
        ELSE date_trunc('month', e.ts) END = b.period_start GROUP BY ALL)
SELECT b.organization_id, b.resource_type, round(coalesce(u.cu, 0.0), 4) AS current_usage,
       CASE WHEN coalesce(CASE WHEN quota_limit > 0 THEN coalesce(u.cu, 0.0) / quota_limit END, 0.0) >= 1.0
            THEN 'exceeded'
            WHEN coalesce(CASE WHEN quota_limit > 0 THEN coalesce(u.cu, 0.0) / quota_limit END, 0.0)
                 >= warning_threshold THEN 'warning' ELSE 'active' END AS status
FROM b LEFT JOIN u USING (organization_id, resource_type)""")
def q_quota_current(spark, d):
    """G1 at a fixed clock: the period containing ``as_of`` per quota, 0
    usage when none (left join + coalesce)."""
    st = usage.quota_status(_quotas(spark), usage.usage_from_events(T(spark, d, "events")),
                            as_of="2024-01-30 12:30:00")
    return st.select("organization_id", "resource_type",
                     F.round("current_usage", 4).alias("current_usage"), "status")


VIOL_SQL = ("(SELECT event_id AS id, 'org_' || (user_id % 3)::VARCHAR AS organization_id, "
            "event_type AS resource_type, CASE WHEN value >= 80 THEN 'exceeded' ELSE 'warning' END "
            "AS violation_type, ts FROM events WHERE value >= 60)")


def _violation_candidates(spark, d):
    return (T(spark, d, "events").where(F.col("value") >= 60)
            .select(F.col("event_id").alias("id"),
                    F.concat(F.lit("org_"), (F.col("user_id") % 3).cast("string"))
                    .alias("organization_id"),
                    F.col("event_type").alias("resource_type"),
                    F.when(F.col("value") >= 80, "exceeded").otherwise("warning")
                    .alias("violation_type"), "ts"))


@register("violations_suppressed", f"""
WITH RECURSIVE v AS {VIOL_SQL},
nx AS (SELECT a.id, (SELECT b.id FROM v b WHERE b.organization_id = a.organization_id
          AND b.resource_type = a.resource_type AND b.violation_type = a.violation_type
          AND b.ts > a.ts + INTERVAL 1 HOUR ORDER BY b.ts, b.id LIMIT 1) AS nid FROM v a),
roots AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY organization_id,
          resource_type, violation_type ORDER BY ts, id) AS rn FROM v) WHERE rn = 1),
chain(id) AS (SELECT id FROM roots UNION ALL
              SELECT nx.nid FROM chain JOIN nx ON nx.id = chain.id WHERE nx.nid IS NOT NULL)
SELECT v.id, v.organization_id, v.resource_type, v.violation_type, v.ts
FROM v JOIN chain USING (id)""")
def q_violations_suppressed(spark, d):
    """Repeat suppression - a violation is recorded only when no
    recorded one of the same (org, resource, type) is within the last hour;
    suppressed ones do not extend the hour. Skew-safe chain marking."""
    v = _violation_candidates(spark, d)
    out = sequence.suppress_repeats(v, ["organization_id", "resource_type", "violation_type"],
                                    "ts", "id", 3600)
    return out.where("emitted").select("id", "organization_id", "resource_type",
                                       "violation_type", "ts")


@register("hourly_window", """
SELECT event_type, date_trunc('hour', ts) AS window_start,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, round(sum(value), 2) AS sum,
       round(sum(value), 2) / count(*) AS average, max(value) AS maximum, count(*) AS points,
       arg_max(value, {'t': ts, 'v': value}) AS latest
FROM events GROUP BY ALL""")
def q_hourly_window(spark, d):
    """1-hour tumbling-window Sum/Average/Maximum + latest point."""
    out = usage.downsample(T(spark, d, "events"), "ts", "value", ["event_type"], "1 hour")
    # values carry two decimals: the rounded sum is exact, and the average is
    # that exact sum over the count (bit-identical in any engine)
    return (out.withColumn("sum", F.round("sum", 2))
            .withColumn("average", F.col("sum") / F.col("points"))
            .withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
            .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))


@register("session_counter", f"""
WITH u AS (SELECT organization_id, resource_type, amount, ts,
             CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new
           FROM {USAGE_SQL} WINDOW w AS (PARTITION BY organization_id, resource_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY organization_id, resource_type ORDER BY ts
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM u)
SELECT organization_id, resource_type, min(ts) AS session_start,
       max(ts) + INTERVAL 1 HOUR AS session_end, round(sum(amount), 4) AS total,
       count(*) AS increments
FROM s GROUP BY organization_id, resource_type, sid""")
def q_session_counter(spark, d):
    """Live counter with 1 h idle expiry = session window per key."""
    out = usage.session_totals(usage.usage_from_events(T(spark, d, "events")), "1 hour")
    return (out.withColumn("total", F.round("total", 4))
            .withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
            .withColumn("session_end", F.col("session_end").cast("timestamp_ntz")))


@register("tenant_scope", f"""
SELECT resource_type, round(sum(amount), 4) AS total, count(*) AS n
FROM {USAGE_SQL} WHERE organization_id = 'org_1' GROUP BY resource_type""")
def q_tenant_scope(spark, d):
    """Reads through a tenant scope see only that tenant's rows."""
    from quarry.tenant import TenantScope

    u = TenantScope("org_1").read(usage.usage_from_events(T(spark, d, "events")))
    return u.groupBy("resource_type").agg(F.round(F.sum("amount"), 4).alias("total"),
                                          F.count(F.lit(1)).alias("n"))


@register("monthly_cost", f"""
SELECT organization_id, date_trunc('month', ts) AS month, round(sum(amount), 4) AS cost,
       count(*) AS items FROM {USAGE_SQL} GROUP BY ALL""")
def q_monthly_cost(spark, d):
    """Month-to-date cost per organization tag (chargeback)."""
    u = usage.usage_from_events(T(spark, d, "events"))
    out = usage.monthly_cost(u, "organization_id", "ts", "amount")
    return out.withColumn("cost", F.round("cost", 4)).transform(_ntz("month"))


def _snapshot(spark, d):
    """Views as storage readings in GB (decimal), purchases as node counts."""
    u = usage.usage_from_events(T(spark, d, "events"))
    u = u.withColumn("amount", F.when(F.col("resource_type") == "view",
                                      F.col("amount") * 1_000_000_000).otherwise(F.col("amount")))
    out = usage.usage_snapshot(u, "2024-01-30 12:00:00", "click", "view", "purchase")
    back = usage.usage_snapshot(usage.usage_from_events(T(spark, d, "events")),
                                "2024-01-30 12:00:00", "click", "view", "purchase")
    return out.drop("cost_this_month").join(back.select("organization_id", "cost_this_month"),
                                            "organization_id")


@register("usage_snapshot", f"""
SELECT organization_id,
       round(sum(CASE WHEN resource_type = 'click' AND ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR
                 THEN amount ELSE 0.0 END), 4) AS dbu_usage,
       round((SELECT avg(v.amount) * 1000000000 / 1073741824.0 FROM {USAGE_SQL} v
        WHERE v.organization_id = u.organization_id AND v.resource_type = 'view'
          AND date_trunc('hour', v.ts) = (
            SELECT max(date_trunc('hour', w.ts)) FROM {USAGE_SQL} w
            WHERE w.organization_id = u.organization_id AND w.resource_type = 'view'
              AND w.ts < TIMESTAMP '2024-01-30 12:00:00')
          AND v.ts < TIMESTAMP '2024-01-30 12:00:00'), 4) AS storage_gb,
       coalesce(max(CASE WHEN resource_type = 'purchase'
                    AND ts >= TIMESTAMP '2024-01-30 11:55:00' THEN floor(amount) END), 0)::BIGINT
         AS compute_nodes,
       round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-01 00:00:00' THEN amount ELSE 0.0 END), 4)
         AS cost_this_month
FROM {USAGE_SQL} u WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY organization_id""")
def q_usage_snapshot(spark, d):
    """Per-organization snapshot (last-hour DBU, storage gauge of the last
    hour with readings, nodes of the last five minutes, MTD cost)."""
    out = _snapshot(spark, d)
    return out.select("organization_id", F.round("dbu_usage", 4).alias("dbu_usage"),
                      F.round("storage_gb", 4).alias("storage_gb"),
                      "compute_nodes", F.round("cost_this_month", 4).alias("cost_this_month"))


# =========================================================== runs

RUNS_SQL = ("(SELECT o_orderkey AS run_id, o_custkey AS pipeline_id, o_orderdate AS started_at, "
            "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' "
            "END AS status, o_totalprice AS records_processed FROM orders)")


@register("latest_run_per_key", f"""
SELECT pipeline_id, run_id, started_at, status FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, run_id DESC) AS rn
  FROM {RUNS_SQL}) WHERE rn = 1""")
def q_latest_run(spark, d):
    """Latest run per pipeline (partial max_by, no window sort)."""
    r = runs.latest_run(runs.runs_from_orders(T(spark, d, "orders")))
    return r.select("pipeline_id", "run_id", F.col("started_at").cast("timestamp_ntz")
                    .alias("started_at"), "status")


@register("run_metrics", f"""
SELECT pipeline_id, count(*) AS total_runs, count_if(status = 'success')::BIGINT AS successful_runs,
       count_if(status = 'failed')::BIGINT AS failed_runs, round(avg(records_processed), 6) AS avg_records
FROM {RUNS_SQL} GROUP BY pipeline_id""")
def q_run_metrics(spark, d):
    """Per-pipeline run counts and averages."""
    m = runs.pipeline_metrics(runs.runs_from_orders(T(spark, d, "orders")))
    return m.drop("avg_minutes").withColumn("avg_records", F.round("avg_records", 6))


@register("run_timeouts", f"""
SELECT CASE WHEN status = 'running' AND
         date_diff('second', started_at, TIMESTAMP '2001-08-01 00:30:00') > 3600 THEN 'timeout'
         ELSE status END AS status, count(*) AS n
FROM {RUNS_SQL} GROUP BY 1""")
def q_run_timeouts(spark, d):
    """Running runs older than 3600 s at the clock become timeouts."""
    r = runs.classify_timeouts(runs.runs_from_orders(T(spark, d, "orders")),
                               "2001-08-01 00:30:00")
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("runs_page", f"""
SELECT run_id, pipeline_id, started_at, status FROM {RUNS_SQL}
ORDER BY started_at DESC, run_id DESC LIMIT 50 OFFSET 20""")
def q_runs_page(spark, d):
    """Newest-first page with id tiebreak (offset 20, limit 50)."""
    r = runs.runs_from_orders(T(spark, d, "orders"))
    return runs.page(r, "started_at", True, "run_id", 20, 50).select(
        "run_id", "pipeline_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        "status")


@register("listing_with_last_run", f"""
WITH p AS (SELECT c_custkey AS pipeline_id, c_name AS name, c_mktsegment AS status FROM customer
           WHERE c_mktsegment = 'MACHINERY' AND (c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%00001%')),
l AS (SELECT pipeline_id, run_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, run_id DESC) AS rn
  FROM {RUNS_SQL}) WHERE rn = 1)
SELECT p.pipeline_id, p.name, l.run_id AS last_run_id, l.status AS last_run_status
FROM p LEFT JOIN l USING (pipeline_id)""")
def q_listing_with_last_run(spark, d):
    """Filtered pipeline list with the last run attached."""
    from quarry.functions.text import ilike_any

    p = T(spark, d, "customer").select(F.col("c_custkey").alias("pipeline_id"),
                                       F.col("c_name").alias("name"),
                                       F.col("c_mktsegment").alias("status"))
    out = runs.pipeline_list(p, runs.runs_from_orders(T(spark, d, "orders")),
                             status="MACHINERY", search=ilike_any(["name", "status"], "00001"))
    return out.select("pipeline_id", "name", "last_run_id", "last_run_status")


# =========================================================== monitoring

SERVICES = [(f"svc_{i}", i % 2 == 0) for i in range(6)]   # svc_6 is unlisted -> critical
HEALTH_SQL = """(SELECT date_trunc('day', ts) AS day, 'svc_' || (user_id % 7)::VARCHAR AS service_name,
  CASE WHEN value > 300 THEN 'unhealthy' WHEN value > 150 THEN 'degraded'
       WHEN value < 1 THEN 'unknown' ELSE 'healthy' END AS status FROM events)"""


@register("health_rollup", f"""
WITH s AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {str(c).lower()})" for n, c in SERVICES)})
           t(service_name, critical)),
r AS (SELECT h.day, h.status, coalesce(s.critical, true) AS critical FROM {HEALTH_SQL} h
      LEFT JOIN s USING (service_name))
SELECT day, count(*) AS services,
       coalesce(CASE max(CASE WHEN critical THEN CASE status WHEN 'healthy' THEN 0
                  WHEN 'degraded' THEN 1 WHEN 'unhealthy' THEN 2 END END)
                WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' WHEN 2 THEN 'unhealthy' END,
                'healthy') AS overall_status
FROM r GROUP BY day""")
def q_health_rollup(spark, d):
    """Worst critical status per day (unknown ignored, unlisted = critical)."""
    ev = T(spark, d, "events")
    h = ev.select(F.date_trunc("DAY", "ts").alias("day"),
                  F.concat(F.lit("svc_"), (F.col("user_id") % 7).cast("string"))
                  .alias("service_name"),
                  F.when(F.col("value") > 300, "unhealthy").when(F.col("value") > 150, "degraded")
                  .when(F.col("value") < 1, "unknown").otherwise("healthy").alias("status"))
    svc = spark.createDataFrame(SERVICES, "service_name string, critical boolean")
    out = monitoring.health_rollup(h, svc, ["day"])
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@register("alert_upsert", """
SELECT 'error_rate' AS name, 'svc_' || (user_id % 7)::VARCHAR AS service,
       'org_' || (user_id % 3)::VARCHAR AS organization_id,
       arg_min(event_id, {'t': ts, 'i': event_id}) AS alert_id,
       arg_max(printf('value %.2f', value), {'t': ts, 'i': event_id}) AS message,
       arg_max(props, {'t': ts, 'i': event_id}) AS details, max(ts) AS created_at,
       count(*) AS occurrences, true AS is_active
FROM events WHERE event_type = 'error' AND event_id % 5 <> 0 GROUP BY ALL
UNION ALL
SELECT 'error_rate', 'svc_' || (user_id % 7)::VARCHAR, 'org_' || (user_id % 3)::VARCHAR, event_id,
       printf('value %.2f', value), props, ts, 1, false
FROM events WHERE event_type = 'error' AND event_id % 5 = 0""")
def q_alert_upsert(spark, d):
    """Active-alert upsert per (name, service, organization); every fifth
    alert is closed and stays by itself."""
    a = (T(spark, d, "events").where(F.col("event_type") == "error")
         .select(F.lit("error_rate").alias("name"),
                 F.concat(F.lit("svc_"), (F.col("user_id") % 7).cast("string")).alias("service"),
                 F.concat(F.lit("org_"), (F.col("user_id") % 3).cast("string"))
                 .alias("organization_id"),
                 F.col("event_id").alias("alert_id"),
                 F.format_string("value %.2f", "value").alias("message"),
                 F.col("props").alias("details"), F.col("ts").alias("created_at"),
                 (F.col("event_id") % 5 != 0).alias("is_active")))
    return monitoring.upsert_alerts(a)


DAILY_SCORE_SQL = ("(SELECT event_type, date_trunc('day', ts) AS day, "
                   "count_if(value <= 100)::DOUBLE / count(*) AS score FROM events GROUP BY ALL)")


def _daily_scores(spark, d):
    return (T(spark, d, "events").groupBy("event_type", F.date_trunc("DAY", "ts").alias("day"))
            .agg((F.count_if(F.col("value") <= 100) / F.count(F.lit(1))).alias("score"))
            .withColumn("day", F.col("day").cast("timestamp_ntz")))


@register("score_trend", f"""
SELECT event_type, day, round(score, 6) AS score, round(lag(score) OVER w, 6) AS previous,
       round(score - lag(score) OVER w, 6) AS change,
       round(avg(score) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
         AS moving_avg
FROM {DAILY_SCORE_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def q_score_trend(spark, d):
    """Daily score, previous, change, 7-day moving average."""
    t = monitoring.score_trend(_daily_scores(spark, d), "event_type", "day", "score")
    return t.select("event_type", "day", *[F.round(c, 6).alias(c) for c in
                                            ("score", "previous", "change", "moving_avg")])


@register("score_anomalies", f"""
SELECT event_type, day,
  coalesce(abs(score - avg(score) OVER w) > 3 * stddev_samp(score) OVER w, false) AS is_anomaly
FROM {DAILY_SCORE_SQL}
WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def q_anomalies(spark, d):
    """Q24: trailing z-score anomaly flag on the daily score."""
    a = monitoring.anomalies(_daily_scores(spark, d), "event_type", "day", "score")
    return a.select("event_type", "day", "is_anomaly")


# =========================================================== lineage, access, catalog

EDGES_SQL = """(
  SELECT 'region:' || r_name AS source, 'nation:' || n_name AS target
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'nation:' || n_name, 'customer:' || c_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'customer:' || c_name, 'order:' || o_orderkey::VARCHAR
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


@register("lineage_closure", f"""
WITH RECURSIVE e AS {EDGES_SQL},
walk(root, node, depth, path) AS (
  SELECT r, r, 0, [r] FROM (SELECT DISTINCT 'region:' || r_name AS r FROM region)
  UNION ALL
  SELECT w.root, e.target, w.depth + 1, list_append(w.path, e.target)
  FROM walk w JOIN e ON e.source = w.node
  WHERE NOT list_contains(w.path, e.target))
SELECT root, depth, count(*) AS n_nodes FROM walk WHERE depth > 0 GROUP BY root, depth""")
def q_lineage(spark, d):
    """Downstream closure from every region (visited set, no depth cap),
    counted per root and depth."""
    edges = lineage.reference_edges(T(spark, d, "region"), T(spark, d, "nation"),
                                    T(spark, d, "customer"), T(spark, d, "orders"))
    roots = T(spark, d, "region").select(F.concat(F.lit("region:"), "r_name").alias("root"))
    walk = lineage.closure(spark, edges, "downstream", roots)
    return walk.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n_nodes"))


@register("lineage_updated", f"""
WITH RECURSIVE e AS {EDGES_SQL},
walk(root, node, depth, path) AS (
  SELECT r, r, 0, [r] FROM (SELECT DISTINCT 'region:' || r_name AS r FROM region)
  UNION ALL
  SELECT w.root, e.target, w.depth + 1, list_append(w.path, e.target)
  FROM walk w JOIN e ON e.source = w.node
  WHERE NOT list_contains(w.path, e.target))
SELECT root, depth, count(*) AS n_nodes FROM walk WHERE depth > 0 GROUP BY root, depth""")
def q_lineage_updated(spark, d):
    """J10, incremental: the closure of an earlier state (customers in debt had no
    nation; open orders hung on a region), brought up to the tables' edges."""
    region, nation = T(spark, d, "region"), T(spark, d, "nation")
    customer, orders = T(spark, d, "customer"), T(spark, d, "orders")
    new = lineage.reference_edges(region, nation, customer, orders)
    names = region.select(F.collect_list("r_name")).scalar()
    stray = orders.where("o_orderstatus = 'O'").select(
        F.concat(F.lit("region:"), F.element_at(
            names, (F.pmod(F.col("o_custkey"), F.size(names)) + 1).cast("int"))).alias("source"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("target"))
    old = lineage.reference_edges(region, nation, customer.where("c_acctbal >= 0"), orders) \
        .unionByName(stray)
    roots = region.select(F.concat(F.lit("region:"), "r_name").alias("root"))
    known = lineage.closure(spark, old, "downstream", roots)
    walk = lineage.update_closure(spark, known, old, new, "downstream", roots)
    return walk.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n_nodes"))


@register("lineage_upstream", f"""
WITH RECURSIVE e AS {EDGES_SQL},
walk(root, node, depth, path) AS (
  SELECT r, r, 0, [r] FROM (SELECT DISTINCT target AS r FROM e WHERE target LIKE 'customer:%')
  UNION ALL
  SELECT w.root, e.source, w.depth + 1, list_append(w.path, e.source)
  FROM walk w JOIN e ON e.target = w.node
  WHERE NOT list_contains(w.path, e.source))
SELECT node, count(*) AS n_customers FROM walk WHERE depth > 0 GROUP BY node""")
def q_lineage_upstream(spark, d):
    """J10 upstream: for every customer its nation and region, counted per
    ancestor."""
    edges = lineage.reference_edges(T(spark, d, "region"), T(spark, d, "nation"),
                                    T(spark, d, "customer"), T(spark, d, "orders"))
    roots = edges.where(F.col("target").startswith("customer:")).select(
        F.col("target").alias("root")).distinct()
    walk = lineage.closure(spark, edges, "upstream", roots)
    return walk.groupBy("node").agg(F.count(F.lit(1)).alias("n_customers"))


ROLES = [("admin", ["*:*"]), ("analyst", ["events:read", "reports:*"]),
         ("engineer", ["events:*", "pipelines:write"]), ("viewer", ["*:read"])]
ROLES_SQL = ("(SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', [{', '.join(repr(p) for p in ps)}])" for r, ps in ROLES) + ") t(role, permissions))")
UR_SQL = ("(SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' "
          "WHEN 2 THEN 'engineer' ELSE 'viewer' END AS role, user_id % 10 <> 9 AS is_active FROM events)")
REQ_SQL = ("(SELECT event_id AS request_id, user_id, CASE event_type WHEN 'purchase' THEN 'pipelines' "
           "WHEN 'signup' THEN 'reports' ELSE 'events' END AS resource, CASE WHEN event_type IN "
           "('view', 'click') THEN 'read' ELSE 'write' END AS action FROM events)")


def _access_inputs(spark, d):
    ev = T(spark, d, "events")
    roles = spark.createDataFrame(ROLES, "role string, permissions array<string>")
    ur = ev.select("user_id").distinct().select(
        "user_id", F.element_at(F.array(*[F.lit(r) for r, _ in ROLES]),
                                (F.col("user_id") % 4 + 1).cast("int")).alias("role"),
        (F.col("user_id") % 10 != 9).alias("is_active"))
    req = ev.select(F.col("event_id").alias("request_id"), "user_id",
                    F.when(F.col("event_type") == "purchase", "pipelines")
                    .when(F.col("event_type") == "signup", "reports").otherwise("events")
                    .alias("resource"),
                    F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write")
                    .alias("action"))
    return roles, ur, req


@register("access_review", f"""
WITH p AS (SELECT role, split_part(perm, ':', 1) AS g_res, split_part(perm, ':', 2) AS g_act
           FROM (SELECT role, unnest(permissions) AS perm FROM {ROLES_SQL})),
up AS (SELECT DISTINCT ur.user_id, p.g_res, p.g_act FROM {UR_SQL} ur JOIN p USING (role)
       WHERE ur.is_active),
r AS (SELECT q.*, EXISTS (SELECT 1 FROM up WHERE up.user_id = q.user_id
        AND up.g_res IN ('*', q.resource) AND up.g_act IN ('*', q.action)) AS allowed
      FROM {REQ_SQL} q)
SELECT resource, action, count(*) AS requests, count_if(allowed)::BIGINT AS allowed FROM r GROUP BY ALL""")
def q_access_review(spark, d):
    """Wildcard grant resolution as an equi-join over expanded forms."""
    roles, ur, req = _access_inputs(spark, d)
    chk = access.check_requests(req, ur, roles)
    return chk.groupBy("resource", "action").agg(F.count(F.lit(1)).alias("requests"),
                                                 F.count_if("allowed").alias("allowed"))


@register("user_permissions", f"""
WITH p AS (SELECT role, split_part(perm, ':', 1) AS resource, split_part(perm, ':', 2) AS action
           FROM (SELECT role, unnest(permissions) AS perm FROM {ROLES_SQL}))
SELECT user_id, count(*) AS n_permissions FROM (
  SELECT DISTINCT ur.user_id, p.resource, p.action FROM {UR_SQL} ur JOIN p USING (role)
  WHERE ur.is_active AND (user_id % 6 <> 0)) GROUP BY user_id""")
def q_user_permissions(spark, d):
    """Set union of permissions over a user's active roles."""
    roles, ur, _ = _access_inputs(spark, d)
    six = F.col("user_id") % 6         # some roles expired before the clock, some run on
    ur = ur.withColumn("expires_at", F.when(six == 0, F.lit("2024-01-30 23:59:59"))
                       .when(six == 1, F.lit("2024-01-31 00:00:01")).cast("timestamp"))
    up = access.user_permissions(ur, roles, as_of=AS_OF)
    return up.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_permissions"))


@register("catalog_search", """
SELECT p_partkey, p_name, least(1.0::DOUBLE, CASE WHEN lower(p_name) = 'bolt' THEN 1.0::DOUBLE
         WHEN contains(lower(p_name), 'bolt') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END
       + CASE WHEN contains(lower(p_type), 'bolt') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
       + CASE WHEN starts_with(lower(p_name), 'bolt') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM part WHERE score > 0 ORDER BY score DESC, p_name, p_partkey LIMIT 25""")
def q_catalog_search(spark, d):
    """Relevance search, sorted globally, top 25."""
    return catalog.search(T(spark, d, "part"), "bolt", "p_name", "p_type", 25,
                          "p_partkey").select("p_partkey", "p_name", "score")


# =========================================================== profiling & discovery

@register("profile_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (count(*) - count({c}))::BIGINT AS null_count, "
    f"count(DISTINCT {c})::BIGINT AS unique_count, round(avg({c}), 7) AS mean, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std, "
    f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(quantile_cont({c}, 0.25), 6) AS q25, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")))
def q_profile_numeric(spark, d):
    """One pass over all numeric columns (exact quantiles)."""
    p = profile.profile_columns(T(spark, d, "lineitem"),
                                ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                 "l_linenumber"])
    return p.select("column_name", "null_count", "unique_count", F.round("mean", 7).alias("mean"),
                    *[F.round(c, 6).alias(c) for c in ("median", "std")], "min", "max",
                    *[F.round(c, 6).alias(c) for c in ("q25", "q75")])


@register("profile_string", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (count(*) - count({c}))::BIGINT AS null_count, "
    f"count(DISTINCT {c})::BIGINT AS unique_count, round(count(DISTINCT {c}) * 100.0 / count(*), 6) "
    f"AS unique_percentage, min(length({c}))::BIGINT AS min_length, max(length({c}))::BIGINT "
    f"AS max_length, round(avg(length({c})), 6) AS avg_length FROM customer"
    for c in ("c_name", "c_mktsegment")))
def q_profile_string(spark, d):
    """String columns - lengths, distinct share."""
    p = profile.profile_columns(T(spark, d, "customer"), ["c_name", "c_mktsegment"])
    return p.select("column_name", "null_count", "unique_count",
                    F.round("unique_percentage", 6).alias("unique_percentage"),
                    "min_length", "max_length", F.round("avg_length", 6).alias("avg_length"))


@register("profile_date", """
SELECT 'ts' AS column_name, min(ts) AS min_date, max(ts) AS max_date,
       floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000)::BIGINT AS date_range_days,
       round((count(*) - count(ts)) * 100.0 / count(*), 6) AS null_percentage FROM events""")
def q_profile_date(spark, d):
    """Date column range in whole days."""
    p = profile.profile_columns(T(spark, d, "events"), ["ts"])
    return p.select("column_name", F.col("min_date").cast("timestamp_ntz").alias("min_date"),
                    F.col("max_date").cast("timestamp_ntz").alias("max_date"), "date_range_days",
                    F.round("null_percentage", 6).alias("null_percentage"))


@register("top5_values", """
SELECT p_name AS value, count(*) AS count FROM part WHERE p_name IS NOT NULL
GROUP BY p_name ORDER BY count DESC, value LIMIT 5""")
def q_top5(spark, d):
    """Five most common values, deterministic tiebreak."""
    return profile.top_values(T(spark, d, "part"), "p_name", 5)


@register("doc_schema_inference", """
SELECT field, string_agg(DISTINCT t, ',' ORDER BY t) AS types, count(*) AS n_docs FROM (
  SELECT k AS field,
         CASE json_type(props, '$."' || k || '"') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer'
              WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
              WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' END AS t
  FROM (SELECT props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)))
GROUP BY field""")
def q_doc_schema(spark, d):
    """Per field the set of observed JSON types (whole table)."""
    return infer_document_schema(T(spark, d, "events"), "props")


PII_SQL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


@register("pii_detect", " UNION ALL ".join(
    f"SELECT '{k}' AS pii_class, count_if(len(regexp_extract_all(text, '{p}')) > 0)::BIGINT AS docs, "
    f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS matches FROM documents"
    for k, p in PII_SQL.items()))
def q_pii_detect(spark, d):
    """PII matches per class over whole documents."""
    from quarry.functions.privacy import pii_counts

    cnt = pii_counts(F.col("text"))
    doc = T(spark, d, "documents").select(*[v.alias(k) for k, v in cnt.items()])
    aggs = []
    for k in cnt:
        aggs += [F.count_if(F.col(k) > 0).alias(f"{k}_docs"), F.sum(k).alias(f"{k}_matches")]
    row = doc.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("pii_class"), F.col(f"{k}_docs").alias("docs"),
                 F.col(f"{k}_matches").cast("bigint").alias("matches")) for k in cnt]))
        .alias("r")).select("r.*")


@register("pii_mask", "SELECT doc_id, " + "".join("regexp_replace(" for _ in PII_SQL) + "text" +
          "".join(f", '{p}', '[{k.upper()}]', 'g')" for k, p in PII_SQL.items()) +
          " AS masked FROM documents")
def q_pii_mask(spark, d):
    """every PII match replaced by its class tag, whole texts."""
    from quarry.functions.privacy import mask_pii

    return T(spark, d, "documents").select("doc_id", mask_pii(F.col("text")).alias("masked"))


@register("lockout_detection", """
WITH RECURSIVE a AS (
  SELECT user_id % 10 AS uid, ts, event_type NOT IN ('error', 'view') AS ok,
         row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS pos FROM events),
s(uid, pos, fails, until, processed, locks) AS (
  SELECT uid, pos, CASE WHEN ok THEN 0 ELSE 1 END, NULL::TIMESTAMP, true, false FROM a WHERE pos = 1
  UNION ALL
  SELECT a.uid, a.pos,
    CASE WHEN s.until IS NOT NULL AND a.ts < s.until THEN s.fails WHEN a.ok THEN 0 ELSE s.fails + 1 END,
    CASE WHEN s.until IS NOT NULL AND a.ts < s.until THEN s.until WHEN a.ok THEN NULL
         WHEN s.fails + 1 >= 5 THEN a.ts + INTERVAL 30 MINUTE ELSE s.until END,
    NOT (s.until IS NOT NULL AND a.ts < s.until),
    NOT (s.until IS NOT NULL AND a.ts < s.until) AND NOT a.ok AND s.fails + 1 >= 5
  FROM s JOIN a ON a.uid = s.uid AND a.pos = s.pos + 1)
SELECT uid, count_if(processed)::BIGINT AS processed, count_if(locks)::BIGINT AS locks, count(*) AS attempts
FROM s GROUP BY uid""")
def q_lockouts(spark, d):
    """Failed-login lockouts (5 consecutive failures -> 30 min lock)
    over attempts derived from events. The oracle steps the state machine
    attempt by attempt with a recursive CTE; the Spark plan marks chains."""
    att = T(spark, d, "events").select(
        "event_id", (F.col("user_id") % 10).alias("uid"), "ts",
        (~F.col("event_type").isin("error", "view")).alias("success"))
    out = sequence.lockouts(att, "uid", "ts", "event_id", "success")
    return out.groupBy("uid").agg(F.count_if("processed").alias("processed"),
                                  F.count_if("locks").alias("locks"),
                                  F.count(F.lit(1)).alias("attempts"))


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("completeness_10_rules", " UNION ALL ".join(
    rule_sql(f"c10_{c}", f"count({c})", "count(*)", 0.95, "lineitem") for c in LI_COLS))
def q_completeness_10(spark, d):
    """Baseline scenario: 10 completeness rules over one table, one pass."""
    return results(run_rules(T(spark, d, "lineitem"),
                             [Rule(f"c10_{c}", "completeness", c) for c in LI_COLS]))


# =========================================================== more operators

@register("failure_samples", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{rid}' AS rule_id, row_number() OVER (ORDER BY p_partkey) AS sample_rank,
  p_partkey, p_name, p_size FROM part WHERE {cond} ORDER BY p_partkey LIMIT 10)""" for rid, cond in (
    ("v_name", "p_name IS NOT NULL AND NOT regexp_matches(p_name, '^(?:(small|large|red|blue))')"),
    ("v_size", "p_size < 5 OR p_size > 45"))))
def q_failure_samples(spark, d):
    """First 10 failing rows per rule by key (two-stage top-k)."""
    from quarry.operators.quality import failure_samples

    rules = [Rule("v_name", "validity", "p_name", {"pattern": "(small|large|red|blue)"}),
             Rule("v_size", "validity", "p_size", {"range": {"min": 5, "max": 45}})]
    return failure_samples(T(spark, d, "part"), rules, ["p_partkey"], 10, ["p_name", "p_size"]) \
        .withColumn("sample_rank", F.col("sample_rank").cast("bigint"))


PATTERN_RULES = [("pr_low", "^src[0-4]$", None), ("pr_teen", "^src1[0-9]$", "^(en|fr)$"),
                 ("pr_any_de", None, "^de$")]


@register("rule_dataset_match", """
WITH r AS (SELECT * FROM (VALUES ('pr_low', '^src[0-4]$', NULL), ('pr_teen', '^src1[0-9]$', '^(en|fr)$'),
                                 ('pr_any_de', NULL, '^de$')) t(rule_id, table_pattern, column_pattern)),
ds AS (SELECT DISTINCT source AS table_name, lang AS column_name FROM documents)
SELECT r.rule_id, ds.table_name, ds.column_name FROM ds JOIN r
  ON (r.table_pattern IS NULL OR regexp_matches(ds.table_name, r.table_pattern))
 AND (r.column_pattern IS NULL OR regexp_matches(ds.column_name, r.column_pattern))""")
def q_rule_dataset_match(spark, d):
    """Pattern rules matched to dataset columns (documents' source as
    the dataset, language as the column)."""
    from quarry.operators.quality.spec import match_rules

    rules = spark.createDataFrame(PATTERN_RULES,
                                  "rule_id string, table_pattern string, column_pattern string")
    ds = T(spark, d, "documents").select(F.col("source").alias("table_name"),
                                         F.col("lang").alias("column_name")).distinct()
    return match_rules(rules, ds).select("rule_id", "table_name", "column_name")


@register("soft_delete", f"""
WITH p AS (SELECT c_custkey AS pipeline_id, true AS is_active, 'active' AS status, c_nationkey FROM customer),
busy AS (SELECT DISTINCT pipeline_id FROM {RUNS_SQL} WHERE status IN ('pending', 'running')),
asked AS (SELECT c_custkey AS pipeline_id FROM customer WHERE c_nationkey = 7)
SELECT p.pipeline_id,
       CASE WHEN a.pipeline_id IS NOT NULL AND b.pipeline_id IS NULL THEN false ELSE p.is_active END AS is_active,
       CASE WHEN a.pipeline_id IS NOT NULL AND b.pipeline_id IS NULL THEN 'archived' ELSE p.status END AS status,
       a.pipeline_id IS NOT NULL AND b.pipeline_id IS NOT NULL AS refused
FROM p LEFT JOIN asked a USING (pipeline_id) LEFT JOIN busy b USING (pipeline_id)""")
def q_soft_delete(spark, d):
    """P20: archive the pipelines of one nation unless a run is in flight."""
    c = T(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("pipeline_id"), F.lit(True).alias("is_active"),
                 F.lit("active").alias("status"))
    ids = c.where(F.col("c_nationkey") == 7).select(F.col("c_custkey").alias("pipeline_id"))
    out = runs.soft_delete(p, runs.runs_from_orders(T(spark, d, "orders")), ids)
    return out.select("pipeline_id", "is_active", "status", "refused")


ORG_LEVELS = {"org_0": "low", "org_1": "high", "org_2": "unknown"}


@register("default_quotas", """
WITH t AS (
  SELECT level, unnest(['dbu_hours', 'storage_gb', 'api_calls', 'concurrent_pipelines',
                        'databricks_clusters', 's3_requests', 'bandwidth_gb']) AS resource_type,
         unnest(limits)::DOUBLE AS quota_limit
  FROM (VALUES ('low', [1000, 1000, 100000, 10, 5, 1000000, 100]),
               ('medium', [5000, 10000, 500000, 25, 10, 5000000, 500]),
               ('high', [20000, 100000, 2000000, 100, 50, 20000000, 2000])) x(level, limits)),
o AS (SELECT DISTINCT 'org_' || (user_id % 3)::VARCHAR AS organization_id FROM events),
ol AS (SELECT organization_id, CASE organization_id WHEN 'org_0' THEN 'low' WHEN 'org_1' THEN 'high'
       ELSE 'medium' END AS level FROM o)
SELECT organization_id, resource_type, quota_limit, 0.8::DOUBLE AS warning_threshold,
       'monthly' AS reset_period FROM ol JOIN t USING (level)""")
def q_default_quotas(spark, d):
    """Default quota rows per organization from its compliance level
    (unknown levels fall back to medium)."""
    lv = F.create_map(*[F.lit(x) for kv in ORG_LEVELS.items() for x in kv])
    orgs = (usage.usage_from_events(T(spark, d, "events")).select("organization_id").distinct()
            .withColumn("compliance_level", lv[F.col("organization_id")]))
    return usage.default_quotas(spark, orgs)


@register("quota_compliance", f"""
WITH s AS (
  SELECT organization_id,
         sum(CASE WHEN resource_type = 'click' AND ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR
             THEN amount ELSE 0.0 END) AS dbu_usage,
         coalesce(max(CASE WHEN resource_type = 'purchase'
                      AND ts >= TIMESTAMP '2024-01-30 11:55:00' THEN floor(amount) END), 0)
           AS compute_nodes,
         (SELECT avg(v.amount) * 1000000000 / 1073741824.0 FROM {USAGE_SQL} v
          WHERE v.organization_id = u.organization_id AND v.resource_type = 'view'
            AND date_trunc('hour', v.ts) = (
              SELECT max(date_trunc('hour', w.ts)) FROM {USAGE_SQL} w
              WHERE w.organization_id = u.organization_id AND w.resource_type = 'view'
                AND w.ts < TIMESTAMP '2024-01-30 12:00:00')
            AND v.ts < TIMESTAMP '2024-01-30 12:00:00') AS storage_gb,
         sum(CASE WHEN ts >= TIMESTAMP '2024-01-01 00:00:00' THEN amount ELSE 0.0 END) AS cost_this_month
  FROM {USAGE_SQL} u WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY organization_id),
l AS (SELECT * FROM (VALUES ('org_0', 5.0, 1000000.0, 1000000, 1000000000.0),
                            ('org_1', 1000000.0, 5.0, 1000000, 1000000000.0),
                            ('org_2', 1000000.0, 1000000.0, 1000000, 1000.0))
      t(organization_id, max_dbu_per_hour, max_storage_gb, max_compute_nodes, monthly_budget_usd))
SELECT organization_id,
       CASE WHEN dbu_usage >= max_dbu_per_hour THEN 'DBU' WHEN storage_gb >= max_storage_gb THEN 'Storage'
            WHEN compute_nodes >= max_compute_nodes THEN 'Compute Nodes'
            WHEN cost_this_month >= monthly_budget_usd THEN 'Monthly Budget' END AS violated,
       NOT (dbu_usage >= max_dbu_per_hour OR storage_gb >= max_storage_gb
            OR compute_nodes >= max_compute_nodes OR cost_this_month >= monthly_budget_usd) AS compliant
FROM s JOIN l USING (organization_id)""")
def q_quota_compliance(spark, d):
    """First violated limit (DBU, storage, nodes, budget) per organization."""
    snap = _snapshot(spark, d)
    limits = spark.createDataFrame(
        [("org_0", 5.0, 1e6, 10 ** 6, 1e9), ("org_1", 1e6, 5.0, 10 ** 6, 1e9),
         ("org_2", 1e6, 1e6, 10 ** 6, 1e3)],
        "organization_id string, max_dbu_per_hour double, max_storage_gb double, "
        "max_compute_nodes bigint, monthly_budget_usd double")
    return usage.compliance(snap.join(limits, "organization_id")).select(
        "organization_id", "violated", "compliant")


@register("current_version", """
SELECT pipeline_id, version, created_at FROM (
  SELECT o_custkey AS pipeline_id, o_orderkey AS version, o_orderdate AS created_at,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1""")
def q_current_version(spark, d):
    """Current version per pipeline (flagged rows, newest if several)."""
    v = T(spark, d, "orders").select(F.col("o_custkey").alias("pipeline_id"),
                                     F.col("o_orderkey").alias("version"),
                                     F.col("o_orderdate").alias("created_at"),
                                     (F.col("o_orderstatus") == "F").alias("is_current"))
    return runs.current_version(v).select("pipeline_id", "version", "created_at")


STAT_COLUMNS = ["l_orderkey", "l_quantity", "l_returnflag", "l_shipdate", "flag"]


@register("table_statistics", """
WITH l AS (SELECT *, nullif(l_returnflag, 'A') AS flag FROM lineitem)
""" + " UNION ALL ".join(
    f"SELECT (SELECT count(*) FROM lineitem) AS row_count, "
    f"(SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) "
    f"AS partition_count, '{c}' AS column_name, count(*) - count({c}) AS null_count, "
    f"count(DISTINCT {c}) AS distinct_count, min({c})::VARCHAR AS min_value, "
    f"max({c})::VARCHAR AS max_value FROM l" for c in STAT_COLUMNS))
def q_table_statistics(spark, d):
    """Row and partition count, and per column nulls, distinct values,
    minimum and maximum."""
    df = T(spark, d, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    st = profile.table_statistics(df, ["l_returnflag", "l_linestatus"], STAT_COLUMNS)
    return st.select("row_count", "partition_count", F.explode("column_stats").alias(
        "column_name", "s")).select("row_count", "partition_count", "column_name", "s.*")


CHECK_RULES = [
    ("qc1", "org_1", "completeness", "orders", "pr", '{"threshold": 0.9}', "alert_only"),
    ("qc2", "org_1", "uniqueness", "orders", "o_orderkey", "{}", "reject"),
    ("qc3", "org_1", "range_check", "orders", "o_totalprice",
     '{"min_value": 1000, "max_value": 400000}', "manual_review"),
    ("qc4", "org_1", "validity", None, "o_orderstatus", '{"allowed_values": ["F", "O"]}',
     "quarantine"),
    ("qc5", "org_2", "completeness", "orders", "pr", "{}", "alert_only"),
    ("qc6", "org_1", "completeness", "customer", "c_name", "{}", "alert_only"),
]
QC_SRC = ("(SELECT o_orderkey, o_totalprice, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS pr "
          "FROM orders)")


@register("quality_check_run", f"""
WITH r AS (
  {rule_sql("qc1", "count(pr)", "count(*)", 0.9, QC_SRC)}
  UNION ALL {rule_sql("qc2", "count(DISTINCT o_orderkey)", "count(*)", 1.0, QC_SRC, 1.0)}
  UNION ALL {rule_sql("qc3", "count_if(o_totalprice IS NULL OR (o_totalprice >= 1000 AND "
                      "o_totalprice <= 400000))", "count(*)", 0.95, QC_SRC)}
  UNION ALL {rule_sql("qc4", "count_if(o_orderstatus IS NULL OR o_orderstatus IN ('F', 'O'))",
                      "count(*)", 1.0, QC_SRC, 1.0)})
SELECT 'org_1' AS organization_id, 'orders' AS dataset_name, count(*) AS total_rules,
       count_if(status = 'passed')::BIGINT AS passed_rules,
       coalesce(count_if(status = 'passed')::DOUBLE / nullif(count(*), 0), 1.0) AS overall_score,
       CASE WHEN count_if(status = 'failed' AND rule_id = 'qc2') > 0 THEN 'failed' ELSE 'success' END
         AS run_status,
       count_if(status = 'failed' AND rule_id = 'qc3')::BIGINT AS incidents,
       count_if(status = 'failed' AND rule_id = 'qc1')::BIGINT AS alerts
FROM r""")
def q_quality_check_run(spark, d):
    """3.2 end to end: tenant/dataset rule selection (Q20) from a rules
    table, one fused pass, remediation routing (R1, R4-R6), score (A7)."""
    from quarry.plans.quality_check import run_quality_check

    rules = spark.createDataFrame(
        [(a, b, c, e, f, g, h, True) for a, b, c, e, f, g, h in CHECK_RULES],
        "id string, organization_id string, rule_type string, table_name string, "
        "column_name string, rule_definition string, remediation_action string, "
        "is_active boolean")
    orders = T(spark, d, "orders").withColumn("pr", F.expr("nullif(o_orderpriority, '5-LOW')"))
    out = run_quality_check(spark, rules, orders, "org_1", "orders", "b1",
                            executed_at="2024-01-31 00:00:00")
    # the batch decision and the counts are one-row results: scalar subqueries
    return out["score"].select(
        "organization_id", "dataset_name", "total_rules", "passed_rules", "overall_score",
        out["batch"].select("run_status").scalar().alias("run_status"),
        out["incidents"].select(F.count(F.lit(1))).scalar().alias("incidents"),
        out["alerts"].select(F.count(F.lit(1))).scalar().alias("alerts"))


REQ_LOG_SQL = """(SELECT user_id, 'org_' || (user_id % 3)::VARCHAR AS tenant_id,
  CASE WHEN value > 100 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_type = 'error' THEN '/health' ELSE '/api/' || event_type END AS path,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS duration_ms,
  '10.0.' || (user_id % 256)::VARCHAR || '.1, 172.16.0.1' AS forwarded_for, ts FROM events)"""


def _request_log(spark, d):
    ev = T(spark, d, "events")
    return ev.select(
        "user_id", F.concat(F.lit("org_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.when(F.col("value") > 100, "POST").otherwise("GET").alias("method"),
        F.when(F.col("event_type") == "error", "/health")
        .otherwise(F.concat(F.lit("/api/"), "event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("duration_ms"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"),
                 F.lit(".1, 172.16.0.1")).alias("forwarded_for"), "ts")


@register("audit_log_build", f"""
SELECT tenant_id, method || ' ' || path AS description, trim(split_part(forwarded_for, ',', 1)) AS ip_address,
       'low' AS severity, count(*) AS n
FROM {REQ_LOG_SQL} WHERE path NOT IN ('/health', '/metrics', '/docs', '/openapi.json')
GROUP BY ALL""")
def q_audit_log_build(spark, d):
    """Request log -> audit rows (excluded paths dropped, first
    forwarded address), counted per tenant, description and address."""
    a = monitoring.audit_rows(_request_log(spark, d))
    return a.groupBy("tenant_id", "description", "ip_address", "severity").agg(
        F.count(F.lit(1)).alias("n"))


@register("retention_purge", f"""
SELECT tenant_id, count(*) AS kept FROM (
  SELECT *, ts + (user_id % 30) * INTERVAL 1 DAY AS retention_until FROM {REQ_LOG_SQL})
WHERE retention_until IS NULL OR retention_until > TIMESTAMP '2024-01-20 00:00:00'
GROUP BY tenant_id""")
def q_retention_purge(spark, d):
    """Audit rows whose retention has not expired at the clock."""
    r = _request_log(spark, d).withColumn(
        "retention_until", F.col("ts") + F.make_dt_interval(F.col("user_id") % 30))
    kept = monitoring.retention_purge(r, "2024-01-20 00:00:00")
    return kept.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("kept"))


@register("top_values_per_column", """
SELECT column_name, value, count, rank FROM (
  SELECT column_name, value, count,
         row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
  FROM (SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS count FROM part
        WHERE p_brand IS NOT NULL GROUP BY p_brand
        UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_type IS NOT NULL GROUP BY p_type
        UNION ALL SELECT 'p_name', p_name, count(*) FROM part WHERE p_name IS NOT NULL GROUP BY p_name))
WHERE rank <= 3""")
def q_top_values_per_column(spark, d):
    """A11/T4 for several columns in one pass (two-stage top-k per column)."""
    out = profile.top_values_all(T(spark, d, "part"), ["p_brand", "p_type", "p_name"], 3)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


from quarry.plans import suite_more  # noqa: E402, F401  (registers its queries)
