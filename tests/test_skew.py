"""A key holding a third of all rows: results stay exact, and no window or
aggregation step partitions by that key alone (it would land whole in one
task)."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import remediate, sequence, usage
from quarry.operators.joins import latest_per_key


@pytest.fixture(scope="module")
def skewed(spark):
    n = 6000
    return (spark.range(n)
            .select(F.col("id").alias("event_id"),
                    F.when(F.col("id") % 3 == 0, F.lit("hot"))
                    .otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
                    .alias("key"),
                    (F.lit(1704067200) + F.col("id") * 37 % 86400 * 3 + F.col("id") % 7)
                    .cast("timestamp").alias("ts"),
                    (F.col("id") % 5 != 0).alias("ok"),
                    (F.col("id") % 97).cast("double").alias("amount")))


def window_specs(df):
    """(partition columns, order text) of every Window in the executed plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    specs = []
    for line in plan.splitlines():
        m = re.search(r"Window \[.*\], \[(.*?)\], \[(.*?)\]", line)
        if m:
            specs.append(([c.split("#")[0].strip() for c in m.group(1).split(",") if c.strip()],
                          m.group(2)))
    return specs


def test_no_window_on_the_key_alone(skewed):
    """Row-level windows are partitioned by (key, slab); a window by the key
    alone only runs over the per-slab summaries (ordered by the slab)."""
    ev = skewed.select("key", F.col("event_id").alias("id"), F.unix_micros("ts").alias("t"))
    frames = [
        sequence.next_at_or_after(ev, ["key"], 3_600_000_000, False),
        sequence.next_at_or_after(ev, ["key"], 0, True, successor=True),
        sequence.sessionize(skewed, ["key"], "ts", 3600),
    ]
    for df in frames:
        specs = window_specs(df)
        assert specs
        for part, order in specs:
            if part == ["key"]:
                assert "slab" in order, (part, order)


def test_skewed_results_match_loops(skewed):
    rows = [(r.key, r.ts, r.event_id, r.ok) for r in skewed.collect()]
    from test_sequence import brute_lockout, brute_suppress

    got = {r.event_id for r in sequence.suppress_repeats(skewed, ["key"], "ts", "event_id")
           .where("emitted").collect()}
    assert got == brute_suppress([(k, t, i) for k, t, i, _ in rows])
    out = sequence.lockouts(skewed, "key", "ts", "event_id", "ok").collect()
    processed, locks = brute_lockout(rows)
    assert {r.event_id for r in out if r.processed} == processed
    assert {r.event_id for r in out if r.locks} == locks


def test_keyed_reductions_are_partial(skewed):
    """max_by / min_by reductions aggregate inside each task before the
    shuffle (a partial aggregate below the exchange)."""
    for df in (latest_per_key(skewed, ["key"], [F.col("ts"), F.col("event_id")]),
               remediate.dedupe_keep_first(skewed, ["key"], [F.col("ts"), F.col("event_id")])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"(Sort|Hash|ObjectHash)Aggregate.*partial", plan, re.S) or \
            plan.count("Aggregate") >= 2
        assert df.count() == 41


def test_sessions_under_skew_match_builtin(skewed):
    u = skewed.select(F.col("key").alias("organization_id"),
                      F.lit("r").alias("resource_type"), "amount", "ts")
    a = usage.session_totals(u).select("organization_id", "session_start", "total",
                                       "increments")
    b = usage.session_totals(u, builtin=True).select("organization_id", "session_start",
                                                     "total", "increments")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
