"""A pipeline run loses no row and records each run id once."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quarry import sinks
from quarry.operators.quality import Rule
from quarry.plans import runner
from quarry.plans.runner import PipelineSpec, run

ROWS = [(1, "a", 5.0), (1, "b", 7.0), (2, None, 9.0), (3, "c", 900.0), (4, "d", 1.0),
        (4, "d", 1.0), (4, "e", 2.0)]
RULES = [Rule("name", "completeness", "name", remediation="quarantine"),
         Rule("big", "range_check", "x", {"max_value": 100}, remediation="auto_fix"),
         Rule("key", "uniqueness", None, {"columns": ["k"], "order_by": ["name"]},
              remediation="auto_fix")]


def folder():
    return tempfile.mkdtemp(prefix="quarry-run-")


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "k int, name string, x double")


def spec(spark, base, target, rows=ROWS, **more):
    return PipelineSpec(source={"frame": frame(spark, rows)}, rules=RULES, target=target,
                        dataset_name="d", state_path=f"{base}/state", **more)


def check(spark, got, written, aside):
    """Rows in = written + quarantined + taken out by a fix."""
    assert (got["records_processed"], got["failed_records"], got["removed_records"]) == (3, 1, 3)
    assert sorted((r.k, r["name"], r.x) for r in written.collect()) == \
        [(1, "a", 5.0), (3, "c", 100.0), (4, "d", 1.0)]
    rows = sorted((r.k, r["name"] or "", r.x, tuple(r["_failed_rules"])) for r in aside.collect())
    assert rows == [(1, "b", 7.0, ("key",)), (2, "", 9.0, ("name",)), (4, "d", 1.0, ("key",)),
                    (4, "e", 2.0, ("key",))]
    assert not {"_run_row"} & {*written.columns, *aside.columns}


def test_path_target(spark):
    base = folder()
    got = run(spark, spec(spark, base, {"path": f"{base}/out"}), "r1")
    check(spark, got, spark.read.parquet(f"{base}/out/r1"),
          spark.read.parquet(f"{base}/out_quarantine/r1"))


def test_table_target(spark):
    base = folder()
    spark.sql("DROP TABLE IF EXISTS run_t")
    one = spec(spark, base, {"table": "run_t"})
    for _ in range(2):  # the same run id twice: the rows are there once
        got = run(spark, one, "r1")
        check(spark, got, spark.table("run_t"), spark.read.parquet(f"{base}/state/quarantine/r1"))
    assert spark.read.parquet(f"{base}/state/runs").count() == 1
    assert {r.rule_id for r in got["results"].collect()} == {"name", "big", "key"}
    spark.sql("DROP TABLE run_t")


def test_merge_target_with_a_named_quarantine(spark):
    base = folder()
    target = {"merge": f"{base}/m", "keys": ["k"], "quarantine": f"{base}/aside"}
    got = run(spark, spec(spark, base, target), "r1")
    check(spark, got, sinks.read_version(spark, f"{base}/m"),
          spark.read.parquet(f"{base}/aside/r1"))


def test_a_target_without_a_quarantine_is_refused_first(spark):
    base = folder()
    spark.sql("DROP TABLE IF EXISTS run_u")
    one = spec(spark, base, {"table": "run_u"})
    one.state_path = None
    with pytest.raises(ValueError, match="quarantine"):
        run(spark, one, "r1")
    assert not spark.catalog.tableExists("run_u")


def test_a_failed_run_is_repeated_from_the_mark_before_it(spark, monkeypatch):
    base = folder()
    plain = [(k, "n", 1.0) for k in range(10)]
    one = lambda rows: spec(spark, base, {"path": f"{base}/out"}, rows,
                            incremental_column="k")
    run(spark, one(plain[:4]), "r1")
    write = runner.write_state

    def fails(s, f, state, name, run_id):
        if name == "runs":
            raise RuntimeError("lost")
        write(s, f, state, name, run_id)
    monkeypatch.setattr(runner, "write_state", fails)
    with pytest.raises(RuntimeError):
        run(spark, one(plain), "r2")
    monkeypatch.setattr(runner, "write_state", write)
    got = run(spark, one(plain), "r2")
    assert got["records_processed"] == 6
    assert {r.k for r in spark.read.parquet(f"{base}/out/r2").collect()} == set(range(4, 10))
    runs = spark.read.parquet(f"{base}/state/runs")
    assert {(r.run_id, r.records_processed) for r in runs.collect()} == {("r1", 4), ("r2", 6)}
    marks = spark.read.parquet(f"{base}/state/marks").groupBy("run_id").count().collect()
    assert {r["count"] for r in marks} == {1}
    assert run(spark, one(plain), "r3")["records_processed"] == 0


def test_run_ids_with_odd_characters(spark):
    base = folder()
    one = spec(spark, base, None)
    got = run(spark, one, "2024-01-01 10:00/a=b")
    assert got["removed_records"] == 3
    again = run(spark, one, "2024-01-01 10:00/a=b")
    assert again["records_processed"] == 3
    row = spark.read.parquet(f"{base}/state/runs").where(
        F.col("run_id") == "2024-01-01 10:00/a=b").collect()
    assert len(row) == 1
