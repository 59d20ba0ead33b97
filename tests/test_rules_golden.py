"""Hand-computed rule answers (FIXTURES part A golden cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators.quality import Rule, run_rules


@pytest.fixture(scope="module")
def users(spark):
    rows = [(1, "John Doe", 25, "john@example.com", 50000, "2023-01-01"),
            (2, "Jane Smith", 30, "jane@example.com", 60000, "2023-01-02"),
            (3, None, 35, "bob@example.com", 70000, "2023-01-03"),
            (4, "Alice Brown", 28, "invalid-email", 55000, "2023-01-04"),
            (5, "Charlie Wilson", 42, "charlie@example.com", 80000, "2023-01-05")]
    return spark.createDataFrame(rows, "id bigint, name string, age bigint, email string, "
                                       "salary bigint, created_at string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_completeness_passes_at_08(users):
    r = one(run_rules(users, [Rule("c", "completeness", "name", {"threshold": 0.8})]))
    assert r.status == "passed" and r.pass_rate == pytest.approx(0.8)
    assert r.failed_records == 1 and r.total_records == 5


def test_completeness_fails_at_09(users):
    r = one(run_rules(users, [Rule("c", "completeness", "name", {"threshold": 0.9})]))
    assert r.status == "failed" and r.pass_rate == pytest.approx(0.8)


def test_uniqueness_pass(users):
    r = one(run_rules(users, [Rule("u", "uniqueness", "id")]))
    assert r.status == "passed" and r.failed_records == 0


def test_uniqueness_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d")],
                               "id bigint, name string")
    r = one(run_rules(df, [Rule("u", "uniqueness", "id")]))
    assert r.status == "failed" and r.failed_records == 1
    assert '"unique_records":4' in r.details


def test_email_validity(users):
    r = one(run_rules(users, [Rule("v", "validity", "email",
                                   {"data_type": "email", "threshold": 0.8})]))
    assert r.status == "passed" and r.failed_records == 1


def test_missing_column_is_error(users):
    r = one(run_rules(users, [Rule("m", "completeness", "nope", dialect="engine")]))
    assert r.status == "error" and "not found in dataset" in r.error


def test_range_outlier(spark):
    amounts = [100.0, 250.0, 75.5, 15000.0, 300.0, 120.0, 80.0, 45.0]
    df = spark.createDataFrame([(i + 1, a) for i, a in enumerate(amounts)],
                               "order_id bigint, amount double")
    r = one(run_rules(df, [Rule("r", "range_check", "amount",
                                {"min_value": 0, "max_value": 10000, "threshold": 0.99})]))
    assert r.status == "failed" and r.pass_rate == pytest.approx(0.875)


def test_customers_email_completeness(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [(i, None if i == 3 else f"n{i}", None if i in (4, 7) else f"c{i}@x.com", 20 + i,
             now - dt.timedelta(days=i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "customer_id bigint, name string, email string, age bigint, "
                                     "created_at timestamp")
    r = one(run_rules(df, [Rule("e", "completeness", "email", {"threshold": 0.95})]))
    assert r.status == "failed" and r.pass_rate == pytest.approx(0.8)


def test_empty_dataset_every_rule_errors(spark):
    df = spark.createDataFrame([], "id bigint, name string")
    res = run_rules(df, [Rule("a", "completeness", "name"), Rule("b", "uniqueness", "id")])
    assert {r.status for r in res.collect()} == {"error"}


def test_warning_band(spark):
    df = spark.createDataFrame([(i, None if i < 2 else "x") for i in range(10)],
                               "id int, v string")
    r = one(run_rules(df, [Rule("w", "completeness", "v",
                                {"threshold": 0.9, "warning_threshold": 0.75})]))
    assert r.status == "warning"


def test_passed_plus_failed_is_total(spark):
    from quarry.plans import suite

    res = suite.QUERIES["validity_rules"](spark, "/root/testdata/sf0.001").collect()
    for r in res:
        assert 0 <= r.failed_records <= r.total_records
        assert r.pass_rate == pytest.approx((r.total_records - r.failed_records) / r.total_records)


def test_runtime_error_is_isolated(spark):
    """Q19 at run time: a rule that fails during execution becomes one error
    row; the other rules of the pass still run."""
    from quarry.operators.quality import register_row_check

    register_row_check("boom", F.udf(lambda x: 1 / 0 > x, "boolean"))
    df = spark.createDataFrame([(1, 0), (2, 1)], "a int, b int")
    res = {r.rule_id: r for r in run_rules(
        df, [Rule("ok", "completeness", "a"),
             Rule("boom", "python", "a", {"check": "boom"}),
             Rule("ok2", "range_check", "a", {"min_value": 0})],
        isolate_runtime_errors=True).collect()}
    assert res["boom"].status == "error" and "runtime error" in res["boom"].error
    assert res["ok"].status == "passed" and res["ok2"].status == "passed"


def test_grouped_checks_keep_custom_sql(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, v int")
    res = run_rules(df, [Rule("c", "completeness", "v"),
                         Rule("s", "custom_sql", None, {"sql_query": "SELECT * FROM {t} WHERE v < 0"})],
                    frames={"t": df}, group_by=["g"]).collect()
    by = {(r.g, r.rule_id): r for r in res}
    assert by[("a", "c")].failed_records == 1 and by[("b", "c")].status == "passed"
    assert by[(None, "s")].status == "passed"


def test_row_errors_are_inconsistent_rows(spark):
    """A row whose condition can't be worked out is an inconsistent row."""
    df = spark.createDataFrame([(4, 2, "1"), (1, 0, "x"), (1, 4, "3"), (None, 1, None)],
                               "m int, n int, t string")
    got = {r.rule_id: (r.status, r.failed_records) for r in run_rules(df, [
        Rule("div", "consistency", None, {"condition": "m / n > 1", "threshold": 0.5}),
        Rule("cast", "consistency", None, {"condition": "cast(t AS int) > 0"}),
        Rule("biz", "accuracy", None, {"method": "business_rule",
                                       "conditions": ["m / n >= 0", "n > 1"]})]).collect()}
    assert got == {"div": ("failed", 3), "cast": ("failed", 2), "biz": ("failed", 2)}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_custom_sql_only_reads_supplied_frames(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS golden_tgt (a int) USING parquet")
    df = spark.createDataFrame([(1,), (2,)], "a int")
    texts = {"ok": "SELECT * FROM {t} WHERE a > 5", "cte": "WITH q AS (SELECT a FROM t) "
             "SELECT * FROM q WHERE a > 7", "write": "WITH q AS (SELECT a FROM {t}) "
             "INSERT INTO golden_tgt SELECT a FROM q", "table": "SELECT * FROM golden_tgt",
             "file": "SELECT * FROM parquet.`/tmp/x`", "drop": "DROP TABLE golden_tgt",
             "reflect": "SELECT reflect('java.util.UUID', 'randomUUID') FROM {t}",
             "brace": "SELECT * FROM {t} WHERE rlike(cast(a AS string), '^9{2}$')",
             "none": "SELECT 1 WHERE 1 = 0"}
    got = {r.rule_id: r.status for r in run_rules(
        df, [Rule(k, "custom_sql", None, {"sql_query": q}) for k, q in texts.items()],
        {"t": df}).collect()}
    assert got == {k: "passed" if k in ("ok", "cte", "brace", "none") else "error" for k in texts}
    assert spark.table("golden_tgt").count() == 0
    spark.sql("DROP TABLE golden_tgt")
