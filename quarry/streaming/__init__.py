"""Structured Streaming ingest.

Streams reuse the batch operators: row-level rule flags inline, set-level
work per micro-batch in ``foreachBatch`` (idempotent on ``batch_id``), and
event-time state bounded by watermarks.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from quarry.operators import usage
from quarry.operators.quality import Rule, compile_rules, run_rules
from quarry.session import cut_lineage, drop_written
from quarry.sinks import _fs, versions


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """X1 (file form) + X8 back-pressure: new files under ``path`` become
    micro-batches of at most ``max_files_per_trigger`` files."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def event_time(df: DataFrame, column: str, delay: str | None) -> DataFrame:
    """Event-time column as TIMESTAMP (parquet NTZ is rejected by
    ``withWatermark``) with a watermark bounding state and lateness
    (``delay=None``: no watermark, e.g. complete-mode outputs)."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def trigger_kwargs(kind: str, interval: str = "60 seconds") -> dict:
    """Batch -> availableNow, micro_batch -> processingTime, streaming ->
    continuous-ish default micro-batches."""
    if kind == "batch":
        return {"availableNow": True}
    if kind == "micro_batch":
        return {"processingTime": interval}
    if kind == "streaming":
        return {}
    raise ValueError(f"unknown pipeline kind: {kind}")


def start(df: DataFrame, checkpoint: str, kind: str = "batch", sink: str = "memory",
          query_name: str | None = None, output_mode: str = "append",
          path: str | None = None, foreach_batch: Callable | None = None, **trigger_opts):
    """Start a streaming query with the pipeline kind's trigger."""
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    trig = trigger_kwargs(kind, **trigger_opts)
    if trig:
        w = w.trigger(**trig)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    else:
        w = w.format(sink)
        if query_name:
            w = w.queryName(query_name)
        if path:
            w = w.option("path", path)
    return w.start()


# ------------------------------------------------------------------ X3, X9

def usage_batch_writer(base: str) -> Callable:
    """``foreachBatch`` body: roll the micro-batch up per (org, resource)
    (A16) and write it under ``batch_id=<id>`` with overwrite - a replayed
    batch rewrites the same folder, so the table stays exactly-once. Quotas
    hold for periods, not batches: ``quota_batch_writer`` judges them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rolled = usage.rollup_batch(batch).withColumn("batch_id", F.lit(batch_id))
        rolled.write.mode("overwrite").parquet(os.path.join(base, "usage", f"batch_id={batch_id}"))
    return write


def cdc_batch_writer(target_path: str, keys: list[str], order_col: str,
                     op_col: str = "op", buckets: int = 32) -> Callable:
    """Apply a change feed per micro-batch; ``op = 'd'`` deletes.

    The target keeps ``order_col`` and, for deleted keys, a marker row, and
    per key the change with the largest ``order_col`` wins (at equal values
    the newer batch): a change that comes late never replaces a newer one
    and never brings a deleted key back. Rows live in ``buckets`` hash
    buckets of the key; a batch writes only the buckets it touches, under
    ``v=<batch_id>``, from versions before its own - so a replayed batch
    reads what it read the first time and rewrites the same folder."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in (*keys, op_col)]
        place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        src = cut_lineage(
            batch.withColumn("_deleted", F.coalesce(F.col(op_col) == "d", F.lit(False)))
            .groupBy(*keys)
            .agg(F.max_by(F.struct(*rest, "_deleted"), F.struct(order_col, "_deleted")).alias("r"))
            .select(*keys, "r.*").withColumn("_bucket", place))
        touched = [r[0] for r in src.select("_bucket").distinct().collect()]  # at most ``buckets``
        new = src.withColumn("_new", F.lit(1))
        cur = _image(spark, target_path, batch_id, touched)
        if cur is not None:
            new = new.unionByName(cur.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        cols = [c for c in new.columns if c not in (*keys, "_new")]
        merged = (new.groupBy(*keys)
                  .agg(F.max_by(F.struct(*cols), F.struct(order_col, "_new")).alias("r"))
                  .select(*keys, "r.*"))
        merged.write.mode("overwrite").partitionBy("_bucket") \
            .parquet(os.path.join(target_path, f"v={batch_id}"))
        drop_written(spark, src)
    return apply


def _image(spark: SparkSession, path: str, before: int | None = None,
           only: list[int] | None = None) -> DataFrame | None:
    """Newest rows of each bucket (of ``only`` these), from finished versions
    smaller than ``before``; markers of deleted keys included."""
    fs, _ = _fs(spark, path)
    newest: dict[int, str] = {}
    for v in versions(spark, path):
        if before is not None and v >= before:
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, f"v={v}"))
        for st in fs.listStatus(folder):
            name = st.getPath().getName()
            if name.startswith("_bucket="):
                newest[int(name[8:])] = os.path.join(path, f"v={v}", name)
    by_version: dict[str, list[str]] = {}
    for n, p in newest.items():
        if only is None or n in only:
            by_version.setdefault(os.path.dirname(p), []).append(p)
    out = None
    for base, folders in by_version.items():  # at most as many as there are buckets
        part = spark.read.option("basePath", base).parquet(*folders)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a CDC target."""
    image = _image(spark, path)
    if image is None:
        raise FileNotFoundError(f"{path} has no finished version")
    return image.where("not _deleted").drop("_deleted", "_bucket")


# ------------------------------------------------------------------ X4, X5

def windowed_usage(stream: DataFrame, period: str = "1 hour", delay: str | None = "10 minutes",
                   slide: str | None = None) -> DataFrame:
    """X5 (+X10 sliding): tumbling or sliding event-time windows per
    (org, resource); append mode emits a window once the watermark passes."""
    s = event_time(stream, "ts", delay)
    w = F.window("ts", period, slide) if slide else F.window("ts", period)
    return (s.groupBy("organization_id", "resource_type", w.alias("w"))
            .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("records"))
            .select("organization_id", "resource_type", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "total", "records"))


def live_counters(stream: DataFrame, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counter per (org, resource) whose expiry is re-armed by every
    increment = session window with an ``idle`` gap."""
    s = event_time(stream, "ts", delay)
    return (s.groupBy("organization_id", "resource_type", F.session_window("ts", idle).alias("s"))
            .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("increments"))
            .select("organization_id", "resource_type", F.col("s.start").alias("session_start"),
                    F.col("s.end").alias("session_end"), "total", "increments"))


# ------------------------------------------------------------------ X6

SUPPRESS_OUT = ("id long, organization_id string, resource_type string, violation_type string, "
                "ts timestamp")
SUPPRESS_STATE = "last_emitted timestamp"


def suppress_stream(violations: DataFrame, window_seconds: int = 3600,
                    delay: str = "2 hours") -> DataFrame:
    """W4 on a stream. State per (org, resource, type) = time of the last
    *emitted* violation; a new one is emitted only when it is more than
    ``window_seconds`` later. The per-key work of a trigger is bounded by the
    micro-batch size (maxFiles/maxOffsets per trigger); state times out once
    the watermark passes the suppression horizon."""
    keys = ["organization_id", "resource_type", "violation_type"]

    gap_us = window_seconds * 1_000_000

    def fold(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        chunks = [p for p in pdfs if len(p)]
        if not chunks:
            return
        pdf = pd.concat(chunks, ignore_index=True).sort_values(["ts", "id"], kind="stable")
        t = pdf["ts"].to_numpy(dtype="datetime64[us]").astype("int64")
        # greedy chain with jumps: the next kept row is the first one more
        # than the window after the last kept one (searchsorted), so the loop
        # runs once per emitted violation, not once per row
        i = 0
        if state.exists:
            last = pd.Timestamp(state.get[0]).to_datetime64().astype("datetime64[us]")
            i = int(np.searchsorted(t, last.astype("int64") + gap_us, side="right"))
        kept = []
        while i < len(t):
            kept.append(i)
            i = int(np.searchsorted(t, t[i] + gap_us, side="right"))
        if kept:
            out = pdf.iloc[kept]
            last_ts = out["ts"].iloc[-1]
            state.update((last_ts,))
            state.setTimeoutTimestamp(int(pd.Timestamp(last_ts).timestamp() * 1000)
                                      + window_seconds * 1000)
            yield out[["id", *keys, "ts"]]

    s = event_time(violations, "ts", delay)
    return s.groupBy(*keys).applyInPandasWithState(
        fold, SUPPRESS_OUT, SUPPRESS_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ X7

def split_rules(stream: DataFrame, rules: list[Rule], frames: dict | None = None,
                as_of=None) -> tuple[list[Rule], list[Rule]]:
    """Rules that can be judged row by row on a stream (also against static
    reference frames), and those that need a whole batch (uniqueness, custom
    SQL, statistics) or could not be planned."""
    checks = compile_rules(stream, rules, frames, as_of)
    inline = [c.rule for c in checks if c.error is None and c.row_valid is not None
              and c.rule.definition.get("method") != "statistical"]
    known = {r.rule_id for r in inline}
    return inline, [c.rule for c in checks if c.rule.rule_id not in known]


def flag_stream(stream: DataFrame, rules: list[Rule], as_of=None,
                frames: dict | None = None) -> DataFrame:
    """Row-level rules evaluated inline on the stream (no state); each
    row gets the ids of the rules it fails. Reference rules join the static
    ``frames``. A rule that can't be judged row by row is an error, not
    skipped: ``split_rules`` tells them apart for ``rules_batch_writer``."""
    inline, rest = split_rules(stream, rules, frames, as_of)
    if rest:
        raise ValueError("not row-level on a stream: " + ", ".join(r.rule_id for r in rest))
    out, flags = stream, []
    for c in compile_rules(stream, inline, frames, as_of):
        if c.prep is not None:
            out = c.prep(out)
        flags.append(F.when(~F.coalesce(c.row_valid, F.lit(False)), F.lit(c.rule.rule_id)))
    arr = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else \
        F.array().cast("array<string>")
    return out.withColumn("_failed_rules", arr).select(*stream.columns, "_failed_rules")


def rules_batch_writer(rules: list[Rule], base: str, frames: dict | None = None) -> Callable:
    """X7 set-level: the fused rule results of each micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        res = run_rules(batch, rules, frames, ctx={"batch_id": str(batch_id)})
        res.write.mode("overwrite").parquet(os.path.join(base, f"batch_id={batch_id}"))
    return write


# ------------------------------------------------------------------ 3.3 flow

def quota_batch_writer(base: str, quotas: DataFrame, window_seconds: int = 3600) -> Callable:
    """Usage -> quota -> violation per micro-batch (the 3.3 flow).

    1. the batch is rolled up per quota period (A16; resources without a
       quota by month) into ``usage/batch_id=<n>`` (overwrite: replay-safe),
       in folders by the period's first day;
    2. current usage per quota period is the sum over the written roll-ups of
       the periods this batch touched (G1) - only their days' folders are read;
    3. each (org, resource) over a threshold of an active quota is a violation
       candidate at the batch's event time (G2) with its action (G3);
    4. a candidate is recorded only when the last *recorded* violation of the
       same (org, resource, type) is more than ``window_seconds`` older (W4);
       with one candidate per key and batch this is a join with the latest
       recorded violation per key, not a chain;
    5. recorded violations go to ``violations/batch_id=<n>`` (overwrite).
    """
    from quarry.functions.periods import period_start_col
    from quarry.operators.joins import latest_per_key

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = ["organization_id", "resource_type"]
        active = usage.active_quotas(quotas)
        period = F.coalesce("reset_period", F.lit("monthly"))
        rolled = (batch.join(active.select(*keys, "reset_period"), keys, "left")
                  .withColumn("period_start", period_start_col(F.col("ts"), period))
                  .groupBy(*keys, "period_start")
                  .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("records"),
                       F.max("ts").alias("last_ts"))
                  .withColumn("period_day", F.to_date("period_start")))
        own = os.path.join(base, "usage", f"batch_id={batch_id}")
        rolled.write.mode("overwrite").partitionBy("period_day").parquet(own)
        usage_tbl = spark.read.schema(StructType(
            [*rolled.schema.fields, StructField("batch_id", LongType())])) \
            .parquet(os.path.join(base, "usage"))
        mine = usage_tbl.where(F.col("batch_id") == batch_id)
        # a micro-batch touches few periods: their days prune the read
        days = [r[0] for r in mine.select("period_day").distinct().collect()]
        current = (usage_tbl.where((F.col("batch_id") <= batch_id) & F.col("period_day").isin(days))
                   .join(mine.select(*keys, "period_start"), [*keys, "period_start"], "left_semi")
                   .groupBy(*keys, "period_start")
                   .agg(F.sum("amount").alias("current_usage"), F.max("last_ts").alias("ts")))
        st = current.join(active, keys, "inner")
        pct = F.when(F.col("quota_limit") > 0, F.col("current_usage") / F.col("quota_limit")) \
            .otherwise(F.lit(0.0))
        cand = (st.withColumn("pct", pct)
                .withColumn("violation_type",
                            F.when(F.col("pct") >= 1.0, "exceeded")
                            .when(F.col("pct") >= F.col("warning_threshold"), "warning"))
                .where(F.col("violation_type").isNotNull())
                .select(*keys, "violation_type", "current_usage", "quota_limit",
                        F.col("ts").alias("created_at"),
                        usage.enforcement_action(F.col("violation_type"), F.col("resource_type"))
                        .alias("action_taken")))
        vkeys = [*keys, "violation_type"]
        vpath = os.path.join(base, "violations")
        if _exists(spark, vpath):
            prev = spark.read.parquet(vpath).where(F.col("batch_id") < batch_id)
            last = latest_per_key(prev.select(*vkeys, "created_at"), vkeys,
                                  [F.col("created_at")]).withColumnRenamed("created_at", "last_at")
            cand = (cand.join(last, vkeys, "left")
                    .where(F.col("last_at").isNull() |
                           (F.unix_micros("created_at") - F.unix_micros("last_at")
                            > window_seconds * 1_000_000))
                    .drop("last_at"))
        (cand.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(os.path.join(vpath, f"batch_id={batch_id}")))
    return write


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)
