"""State of streams in tables of their own.

Writers for ``foreachBatch`` that keep what a stream has to remember in a table
under ``base``. A batch reads the state that was there before it and adds its own
under its number, so a batch that is replayed (after a failure, or after an
executor was lost) finds what it found the first time and writes the same again.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.periods import period_start_col
from quarry.operators.chains import UNLOCKED, lock_chains
from quarry.operators.sequence import to_micros
from quarry.session import cut_lineage, drop_written
from quarry.sinks import _fs, versioned, versions

VIOLATION_KEYS = ["organization_id", "resource_type", "violation_type"]


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state that the batch before this one left."""
    earlier = [v for v in versions(spark, path) if v < batch_id]
    return spark.read.parquet(os.path.join(path, f"v={earlier[-1]}")) if earlier else None


def _keep(state: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's state; those before the one it started from go."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(os.path.join(path, f"v={batch_id}"))
    for v in [v for v in versions(spark, path) if v < batch_id][:-1]:
        fs, folder = _fs(spark, os.path.join(path, f"v={v}"))
        fs.delete(folder, True)


def suppression_writer(base: str, keys: list[str] | None = None, ts: str = "ts",
                       id_col: str = "id", window_seconds: int = 3600,
                       resolved: str | None = None, lateness_seconds: int = 7200,
                       rows: int | None = None) -> Callable:
    """W4 on a stream, over unresolved violations if ``resolved`` names a
    column. Each batch runs ``chains.lock_chains`` from the states that the last
    one left, so a key of any share of a batch is spread over tasks, and batches in
    order of time give what the batch operator gives. Emitted rows go to
    ``emitted/batch_id=<n>``. A key's state goes once its lock ended
    ``lateness_seconds`` before the latest lock begins; an event that comes later
    than that is judged as if nothing had been emitted before it."""
    keys = keys or VIOLATION_KEYS
    names = [f"k{i}" for i in range(len(keys))]
    lock = window_seconds * 1_000_000 + 1
    options = {"rows": rows} if rows else {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, os.path.join(base, "state")
        staged = cut_lineage(batch)
        done = F.lit(False) if resolved is None else F.col(resolved)
        ev = staged.select(*(F.col(k).alias(n) for k, n in zip(keys, names)),
                           F.col(id_col).alias("id"), to_micros(staged, ts).alias("t"),
                           done.alias("ok"))
        before = _before(spark, path, batch_id)
        marked, exits = lock_chains(ev, names, 1, lock, entry=before, **options)
        emitted = staged.join(marked.select(F.col("id").alias(id_col)), id_col, "left_semi")
        emitted.select(*batch.columns).write.mode("overwrite").parquet(
            os.path.join(base, "emitted", f"batch_id={batch_id}"))
        state = exits
        if before is not None:
            same = [F.col(f"o.{n}").eqNullSafe(F.col(f"e.{n}")) for n in names]
            on = same[0]
            for c in same[1:]:
                on = on & c
            state = exits.unionByName(before.alias("o").join(exits.alias("e"), on, "left_anti"))
        horizon = state.agg(F.max("state")).first()[0]  # one number
        if horizon is not None and horizon > UNLOCKED:
            state = state.where(F.col("state") >= horizon - lock - lateness_seconds * 1_000_000)
        _keep(state.where(F.col("state") > UNLOCKED), path, batch_id)
        for table in (staged, marked, exits):
            drop_written(spark, table)
    return write


def totals_writer(base: str, period: str = "monthly", metadata_col: str | None = None,
                  id_col: str = "event_id", leaf_rows: int = versioned.LEAF_ROWS) -> Callable:
    """Running totals of (organization, resource, period) with the merged
    metadata (per key, the newest value), as a versioned table: a batch rewrites
    only the leaves of the totals it touches, whatever came before it, and is
    applied once. ``read_totals`` gives the rows."""
    group = ["organization_id", "resource_type", "period_start"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("period_start", period_start_col(F.col("ts"), F.lit(period)))
        parts = rows.groupBy(*group).agg(
            F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("records"),
            F.max("ts").alias("last_ts")).withColumns(
            {"k": F.lit(None).cast("string"), "v": F.lit(None).cast("string"),
             "v_at": F.lit(None).cast("struct<ts: timestamp, id: long>")})
        if metadata_col:
            at = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col(id_col).cast("long").alias("id"))
            entries = rows.select(*group, at.alias("v_at"), F.explode(metadata_col).alias("k", "v")) \
                .groupBy(*group, "k").agg(F.max(F.struct("v_at", "v")).alias("m"))
            parts = parts.unionByName(entries.select(
                *group, "k", F.col("m.v").alias("v"), F.col("m.v_at").alias("v_at")),
                allowMissingColumns=True)

        def combine(current: DataFrame | None, new: DataFrame) -> DataFrame:
            both = new if current is None else current.select(*new.columns).unionByName(new)
            return both.groupBy(*group, "k").agg(
                F.sum("amount").alias("amount"), F.sum("records").alias("records"),
                F.max("last_ts").alias("last_ts"), F.max(F.struct("v_at", "v")).alias("m")) \
                .select(*group, "amount", "records", "last_ts", "k", F.col("m.v").alias("v"),
                        F.col("m.v_at").alias("v_at")).select(*new.columns)
        # metadata keys lie apart from each other: a group of many keys is spread
        versioned.update(spark, os.path.join(base, "totals"), parts, [*group, "k"], combine,
                         writer="totals", batch=batch_id, leaf_rows=leaf_rows)
        versioned.expire(spark, os.path.join(base, "totals"), keep=3)
    return write


def read_totals(spark: SparkSession, base: str) -> DataFrame:
    """``organization_id, resource_type, period_start, usage, records, last_ts,
    metadata`` (a map, built here on reading)."""
    group = ["organization_id", "resource_type", "period_start"]
    return versioned.read(spark, os.path.join(base, "totals")).groupBy(*group).agg(
        F.sum("amount").alias("usage"), F.sum("records").alias("records"),
        F.max("last_ts").alias("last_ts"),
        F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
        .alias("metadata"))


def late_split_writer(base: str, ts: str = "ts", delay_seconds: int = 600,
                      on_time: Callable | None = None) -> Callable:
    """Rows behind the watermark go to ``late/batch_id=<n>`` instead of
    being lost; the others to ``on_time(batch, batch_id)``, or to
    ``kept/batch_id=<n>``. The watermark of a batch is the latest event time of all
    batches before it less ``delay_seconds``; rows without a time are late."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, os.path.join(base, "watermark")
        staged = cut_lineage(batch)
        t = to_micros(staged, ts)
        before = _before(spark, path, batch_id)
        seen = before.first()["latest"] if before is not None else None
        late = t.isNull() if seen is None else \
            t.isNull() | (t < F.lit(seen - delay_seconds * 1_000_000))
        staged.where(late).write.mode("overwrite").parquet(
            os.path.join(base, "late", f"batch_id={batch_id}"))
        kept = staged.where(~late)
        if on_time is not None:
            on_time(kept, batch_id)
        else:
            kept.write.mode("overwrite").parquet(os.path.join(base, "kept", f"batch_id={batch_id}"))
        latest = staged.agg(F.max(t).alias("m")).select(
            F.greatest(F.col("m"), F.lit(seen).cast("long")).alias("latest"))
        _keep(latest, path, batch_id)
        drop_written(spark, staged)
    return write
