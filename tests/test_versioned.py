"""Versioned tables and what streams keep in tables of their own."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import sequence, usage
from quarry.sinks import versioned
from quarry.streaming import state

SF001 = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="quarry-versioned-")


def kv(spark, rows):
    return spark.createDataFrame(rows, "k string, v long, gone boolean")


def image(spark, path, version=None):
    return {r.k: r.v for r in versioned.read(spark, path, version).collect()}


def test_leaves_split_and_every_version_reads(spark):
    path, want, rng = folder(), {}, random.Random(1)
    seen = []
    for step in range(4):
        rows = [(f"k{rng.randrange(400)}", step * 1000 + i, rng.random() < 0.1) for i in range(150)]
        rows = list({k: (k, v, g) for k, v, g in rows}.values()) + \
            ([(None, 7, False)] if step == 1 else [])
        versioned.merge(spark, path, kv(spark, rows), ["k"], delete_col="gone", leaf_rows=40)
        for k, v, gone in rows:
            want.pop(k, None)
            if not gone:
                want[k] = v
        # a null key never equals another: the row of step 1 stays
        seen.append(dict(want))
    found = versioned.history(spark, path)
    assert found == [0, 1, 2, 3]
    for v in found:
        assert image(spark, path, v) == seen[v]
    leaves = versioned.manifest(spark, path, 3)["leaves"]
    assert len(leaves) > 4 and max(x["rows"] for x in leaves.values() if x) <= 80
    assert sum(x["rows"] for x in leaves.values() if x) == len(want)


def test_untouched_leaves_keep_their_folders(spark):
    path = folder()
    versioned.merge(spark, path, kv(spark, [(f"k{i}", i, False) for i in range(200)]), ["k"],
                    leaf_rows=20)
    before = versioned.manifest(spark, path, 0)["leaves"]
    versioned.merge(spark, path, kv(spark, [("k5", -5, False)]), ["k"], leaf_rows=20)
    after = versioned.manifest(spark, path, 1)["leaves"]
    changed = [n for n in before if after[n] != before[n]]
    assert len(changed) == 1 and image(spark, path)["k5"] == -5 and len(image(spark, path)) == 200


def test_two_writers_cannot_publish_one_number(spark, monkeypatch):
    path = folder()
    versioned.merge(spark, path, kv(spark, [("a", 1, False)]), ["k"])
    publish, raced = versioned._publish, []

    def race(s, p, content):
        if not raced:  # another writer is faster, once
            raced.append(content["version"])
            versioned.merge(s, p, kv(s, [("b", 2, False)]), ["k"])
        publish(s, p, content)
    monkeypatch.setattr(versioned, "_publish", race)
    assert versioned.merge(spark, path, kv(spark, [("c", 3, False)]), ["k"]) == 2
    assert raced == [1] and image(spark, path) == {"a": 1, "b": 2, "c": 3}
    assert image(spark, path, 1) == {"a": 1, "b": 2}
    with pytest.raises(versioned.Conflict):
        publish(spark, path, {"version": 1})


def test_batches_apply_once_and_expiry_spares_kept_versions(spark):
    path = folder()
    for batch, rows in ((0, [("a", 1, False)]), (1, [("a", 2, False)]), (1, [("a", 9, False)]),
                        (2, [("b", 3, False)])):
        versioned.merge(spark, path, kv(spark, rows), ["k"], writer="w", batch=batch)
    assert versioned.history(spark, path) == [0, 1, 2]
    reader = versioned.read(spark, path, 1)
    assert not versioned.expire(spark, path, keep=2)        # too young to go
    gone = versioned.expire(spark, path, keep=2, grace_seconds=0)
    assert len(gone) == 1 and versioned.history(spark, path) == [1, 2]
    assert {r.k: r.v for r in reader.collect()} == {"a": 2}
    assert image(spark, path) == {"a": 2, "b": 3}
    versioned.merge(spark, path, kv(spark, [("a", 0, True), ("b", 0, True)]), ["k"],
                    delete_col="gone")
    assert versioned.read(spark, path).columns == ["k", "v", "gone"] and not image(spark, path)


def usage_rows(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    return usage.usage_from_events(ev).withColumn("meta", F.create_map(
        F.concat(F.lit("m"), F.col("event_id") % 7), F.col("event_id").cast("string")))


def test_running_totals_after_late_and_replayed_batches(spark):
    base, u = folder(), usage_rows(spark)
    write = state.totals_writer(base, "daily", "meta", leaf_rows=200)
    for batch, part in enumerate((2, 0, 1)):        # days come in any order
        rows = u.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
        write(rows, batch)
        if batch == 1:
            write(rows, batch)                      # replayed
    write(u.where(F.lit(False)), 3)
    got = {(r.organization_id, r.resource_type, r.period_start): (round(r.usage, 4), r.records,
                                                                  r.metadata)
           for r in state.read_totals(spark, base).collect()}
    want = {(r.organization_id, r.resource_type, r.period_start): (round(r.usage, 4), r.records)
            for r in usage.usage_per_period(u, "daily").collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    newest = {}
    for r in u.withColumn("day", F.date_trunc("day", "ts")).collect():
        group = newest.setdefault((r.organization_id, r.resource_type, r.day), {})
        for k, v in r.meta.items():
            group[k] = max(group.get(k, (r.ts, r.event_id, v)), (r.ts, r.event_id, v))
    assert {k: v[2] for k, v in got.items()} == \
        {g: {k: v[2] for k, v in m.items()} for g, m in newest.items()}
    leaves = versioned.manifest(spark, f"{base}/totals",
                                versioned.history(spark, f"{base}/totals")[-1])["leaves"]
    assert len(leaves) > 1


def violations(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").where(F.col("value") >= 40)
    return ev.select(F.col("event_id").alias("id"), F.lit("hot").alias("organization_id"),
                     F.lit("r").alias("resource_type"), F.lit("exceeded").alias("violation_type"),
                     F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0)
                     .alias("done"))


@pytest.mark.parametrize("resolved", [None, "done"])
def test_suppression_over_triggers_equals_the_batch_operator(spark, resolved):
    """One hot key, several triggers, each cut into many slabs; one is replayed."""
    base, v = folder(), violations(spark)
    write = state.suppression_writer(base, resolved=resolved, rows=50)
    days = sorted(r[0] for r in v.select(F.to_date("ts")).distinct().collect())
    third = len(days) // 3
    for batch, part in enumerate((days[:third], days[third:third + 1], days[third + 1:])):
        rows = v.where(F.to_date("ts").isin(part))
        write(rows, batch)
        if batch == 1:
            write(rows, batch)
    got = {r.id for r in spark.read.parquet(f"{base}/emitted").collect()}
    want = {r.id for r in sequence.suppress_repeats(
        v, state.VIOLATION_KEYS, "ts", "id", resolved=resolved).where("emitted").collect()}
    assert got == want
    assert len([n for n in os.listdir(f"{base}/state") if n.startswith("v=")]) == 2


def test_late_rows_are_kept_beside(spark):
    """Kept and late rows are the input; a stream reads it file by file."""
    base, t0 = folder(), dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    batches = [[(1, at(0)), (2, at(30))], [(3, at(25)), (4, at(5)), (5, at(60)), (6, None)],
               [(7, at(49)), (8, at(51)), (9, at(20))]]
    write = state.late_split_writer(base, delay_seconds=600)
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "id long, ts timestamp")
        write(frame, i)
        write(frame, i)
    kept = {r.id for r in spark.read.parquet(f"{base}/kept").collect()}
    late = {r.id for r in spark.read.parquet(f"{base}/late").collect()}
    assert late == {4, 6, 7, 9} and kept == {1, 2, 3, 5, 8}


def test_late_split_and_totals_in_a_stream(spark):
    from quarry import streaming
    base, u = folder(), usage_rows(spark).drop("props")
    u.repartition(4, "event_id").write.parquet(f"{base}/in")
    totals = state.totals_writer(base, "daily", "meta")
    write = state.late_split_writer(base, delay_seconds=86_400, on_time=totals)
    q = streaming.start(streaming.file_stream(spark, f"{base}/in", u.schema,
                                              max_files_per_trigger=1),
                        f"{base}/ck", "batch", foreach_batch=write)
    q.awaitTermination()
    late = spark.read.parquet(f"{base}/late").count()
    records = state.read_totals(spark, base).agg(F.sum("records")).first()[0]
    assert late > 0 and records + late == u.count()
