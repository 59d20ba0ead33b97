"""End-to-end pipeline plan (3.1): read -> transform chain -> observe ->
quality rules -> split -> write -> run row.

One process builds one Catalyst plan per output; there is no generated
program text, no job polling and no per-step ``count()``.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry import sinks
from quarry.operators import remediate
from quarry.operators.quality import Rule, row_flags, run_rules, without_row_form
from quarry.operators.quality.spec import REMEDIATIONS
from quarry.operators.transforms import (apply_transforms, high_water_mark, incremental_filter,
                                         ingest_metadata, last_value_from)
from quarry.session import cut_lineage, drop_written


@dataclass
class PipelineSpec:
    source: dict                      # {"format": "parquet", "path": ...} or {"frame": df}
    transforms: list[dict] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    target: dict | None = None        # see write_target
    organization: str | None = None
    environment: str = "dev"
    incremental_column: str | None = None
    last_value: object = None
    quarantine: bool = False
    dataset_name: str = "dataset"
    state_path: str | None = None     # results, alerts, incidents, runs, marks


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    if "frame" in source:
        return source["frame"]
    from quarry.sources.files import scan_file

    return scan_file(spark, source["path"], source.get("format", "parquet"),
                     source.get("schema"), source.get("infer_schema", False),
                     source.get("options"))


def build(spark: SparkSession, spec: PipelineSpec, frames: dict | None = None) -> DataFrame:
    """The transformed frame (lazy): source, incremental filter, chain."""
    df = read_source(spark, spec.source)
    if spec.incremental_column:
        df = incremental_filter(df, spec.incremental_column, spec.last_value)
    return apply_transforms(df, spec.transforms, frames)


def quality_of(spark: SparkSession, spec: PipelineSpec, frames: dict | None = None,
               as_of=None, ctx: dict | None = None) -> DataFrame:
    """Fused rule results over the transformed frame."""
    return run_rules(build(spark, spec, frames), spec.rules, frames, as_of, ctx)


def run(spark: SparkSession, spec: PipelineSpec, run_id: str, frames: dict | None = None,
        as_of=None) -> dict:
    """Execute a pipeline: read the mark, filter, transform, stage once, judge,
    act, write, record.

    Rules are judged on the staged frame, and each failed rule's remediation
    action takes effect: ``reject`` - nothing is written to the target and
    the mark stays; ``auto_fix`` - values are fixed (or duplicates dropped);
    ``quarantine`` - the rule's bad rows go to the quarantine folder;
    ``manual_review`` and ``alert_only`` - incident and alert rows. With
    ``spec.quarantine`` every rule's bad rows are quarantined. A rule that its
    action can't be applied to (no row form, no fix) is listed in the run row,
    not skipped.

    No row is lost: rows read = ``records_processed`` (written) +
    ``failed_records`` (quarantined) + ``removed_records`` (dropped by a fix).
    The latter two are written, as read and with the rules that took them out,
    to ``quarantine_folder``; a target that has none is refused before anything
    is written.

    State lies under ``spec.state_path`` in a folder per run id, the run row
    last. A run that failed before is repeated: it starts from the mark before
    its own, and writes its folders anew. A finished run id is not run again: its
    recorded row and frames come back, and no target gets its rows twice. (A
    repeat after a failure between an append to a table, JDBC or Kafka target and
    the run row appends again; path and merge targets do not.) Returns the run row
    as a dict and the frames ``results``, ``alerts`` and ``incidents``.
    """
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    state = spec.state_path
    if state and (row := finished_run(spark, state, run_id)):
        return {**row, **recorded(spark, state, run_id)}
    last = spec.last_value
    if spec.incremental_column and last is None and state:
        last = read_mark(spark, f"{state}/marks", spec, run_id)
    df = build(spark, dataclasses.replace(spec, last_value=last), frames)
    if spec.organization:
        df = ingest_metadata(df, spec.organization, spec.environment)
    staged = cut_lineage(df.withColumn(ROW, F.monotonically_increasing_id()))
    base = staged.drop(ROW)
    ctx = {"organization_id": spec.organization, "dataset_name": spec.dataset_name,
           "batch_id": run_id, "executed_at": started}
    results = cut_lineage(run_rules(base, spec.rules, frames, as_of, ctx,
                                    isolate_runtime_errors=True))
    # one row per rule: as many as the configuration has
    failed = {r.rule_id for r in results.where("status = 'failed'").collect()}
    by_action = {a: [r for r in spec.rules if r.remediation == a and r.rule_id in failed]
                 for a in REMEDIATIONS}
    if spec.quarantine:
        by_action["quarantine"] = list(spec.rules)
    rejected = [r.rule_id for r in by_action["reject"]]

    gaps = without_row_form(base, by_action["quarantine"], frames, as_of)
    unfixed = remediate.unfixable(base, by_action["auto_fix"])
    split = [r for r in by_action["quarantine"] if r.rule_id not in gaps]
    fixes = [r for r in by_action["auto_fix"] if r.rule_id not in unfixed]
    temporary, aside = [staged], {}
    out, counts = None, {"kept": 0, "bad": 0, "removed": 0}
    if not rejected:
        kept = staged
        if split:
            flagged = cut_lineage(row_flags(staged, split, frames, as_of))
            temporary.append(flagged)
            aside["bad"] = flagged.where(F.size("_failed_rules") > 0).drop(ROW)
            kept = flagged.where(F.size("_failed_rules") == 0).drop("_failed_rules", "_reasons")
        if fixes:
            kept, aside["removed"] = fixed(kept, fixes, temporary)
        aside = {n: f for n, f in aside.items() if f is not None}
        folder = quarantine_folder(spec)
        if aside and spec.target and not folder:
            raise ValueError("the target has no folder for quarantined rows: name one as "
                             "target['quarantine'] or set a state path")
        if aside:
            counts.update(set_aside(spark, aside, folder if spec.target else None, run_id))
        obs = Observation(f"run_{run_id}")
        out = write_target(kept.drop(ROW).observe(obs, F.count(F.lit(1)).alias("n")),
                           spec.target, run_id)
        counts["kept"] = obs.get["n"]
    rules = rule_rows(spark, spec)
    routed = remediate.route(results, rules)
    frames_out = {"results": results, "alerts": remediate.alerts(routed),
                  "incidents": remediate.incidents(routed)}
    finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = {"run_id": run_id, "organization_id": spec.organization,
           "dataset_name": spec.dataset_name, "status": "failed" if rejected else "success",
           "records_processed": counts["kept"], "failed_records": counts["bad"],
           "removed_records": counts["removed"],
           "output_bytes": folder_bytes(spark, out), "output": out, "rejected_by": rejected,
           "unflagged_rules": sorted(gaps), "unfixed_rules": sorted(unfixed),
           "started_at": started, "completed_at": finished,
           "seconds": (finished - started).total_seconds()}
    if state:
        for name, frame in frames_out.items():
            write_state(spark, frame, state, name, run_id)
        if spec.incremental_column and not rejected:
            write_state(spark, high_water_mark(base, spec.incremental_column, spec.dataset_name)
                        .where("last_value is not null"), state, "marks", run_id)
        write_state(spark, spark.createDataFrame([tuple(row.values())], RUN_SCHEMA)
                    .drop("run_id"), state, "runs", run_id)
        temporary.append(results)
        frames_out = recorded(spark, state, run_id)
    for table in temporary:
        drop_written(spark, table)
    return {**row, **frames_out}


ROW = "_run_row"  # of a run's staged rows


def fixed(kept: DataFrame, fixes: list[Rule], temporary: list) -> tuple[DataFrame, DataFrame | None]:
    """The fixed rows, and the rows that fixes took out (as they were before)."""
    takers = [r.rule_id for r in fixes if r.normalized().rule_type == "uniqueness"]
    out = remediate.auto_fix(kept, fixes)
    if not takers:
        return out, None
    out = cut_lineage(out)
    temporary.append(out)
    gone = kept.join(out.select(ROW), ROW, "left_anti").drop(ROW)
    return out, gone.withColumns({
        "_failed_rules": F.array(*map(F.lit, takers)),
        "_reasons": F.array(*(F.lit(f"{r}: dropped by auto_fix") for r in takers))})


def quarantine_folder(spec: PipelineSpec) -> str | None:
    """Where rows go that a run takes out: ``target['quarantine']``, beside a
    path target, or in the state folder."""
    target = spec.target or {}
    if "quarantine" in target:
        return target["quarantine"]
    if "path" in target:
        return target["path"] + "_quarantine"
    return f"{spec.state_path}/quarantine" if spec.state_path else None


def set_aside(spark: SparkSession, parts: dict[str, DataFrame], folder: str | None,
              run_id: str) -> dict[str, int]:
    """Write the rows taken out in one job, and count each part of them. Without
    a folder (a run that has no target) they are only counted."""
    seen = {n: Observation(f"{n}_{run_id}") for n in parts}
    whole = None
    for n, f in parts.items():
        f = f.observe(seen[n], F.count(F.lit(1)).alias("n"))
        whole = f if whole is None else whole.unionByName(f)
    if folder:
        sinks.write_run(whole, folder, run_id)
    else:
        whole.write.format("noop").mode("overwrite").save()
    return {n: o.get["n"] for n, o in seen.items()}


def _state_folder(spark: SparkSession, state: str, name: str, run_id: str) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{state}/{name}/run_id={escape(run_id)}"


def write_state(spark: SparkSession, frame: DataFrame, state: str, name: str, run_id: str) -> None:
    """A run's rows of a state table, in a folder of its own."""
    frame.write.mode("overwrite").parquet(_state_folder(spark, state, name, run_id))


def recorded(spark: SparkSession, state: str, run_id: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(_state_folder(spark, state, n, run_id))
            for n in ("results", "alerts", "incidents")}


def finished_run(spark: SparkSession, state: str, run_id: str) -> dict | None:
    """The run row of a run id that is already recorded."""
    folder = _state_folder(spark, state, "runs", run_id)
    fs, done = sinks._fs(spark, f"{folder}/_SUCCESS")
    return {"run_id": run_id, **spark.read.parquet(folder).first().asDict()} \
        if fs.exists(done) else None


RUN_SCHEMA = ("run_id string, organization_id string, dataset_name string, status string, "
              "records_processed long, failed_records long, removed_records long, "
              "output_bytes long, output string, "
              "rejected_by array<string>, unflagged_rules array<string>, "
              "unfixed_rules array<string>, started_at timestamp, completed_at timestamp, "
              "seconds double")


def rule_rows(spark: SparkSession, spec: PipelineSpec) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.remediation) for r in spec.rules],
                                 "id string, remediation_action string")


def read_mark(spark: SparkSession, path: str, spec: PipelineSpec, run_id: str | None = None):
    """The last mark of a spec's source column, in the column's own type; not
    the one that an earlier try of ``run_id`` left."""
    fs, folder = sinks._fs(spark, path)
    if not fs.exists(folder):
        return None
    marks = spark.read.parquet(path)
    if run_id is not None:
        marks = marks.where(F.col("run_id").cast("string") != run_id)
    found = last_value_from(marks, spec.dataset_name, spec.incremental_column).collect()
    if not found:
        return None
    return spark.sql(f"SELECT CAST(:v AS {found[0].value_type}) AS v",
                     args={"v": found[0].last_value}).first().v


def folder_bytes(spark: SparkSession, path: str | None) -> int:
    if not path:
        return 0
    fs, folder = sinks._fs(spark, path)
    return fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0


def write_target(df: DataFrame, target: dict | None, run_id: str) -> str | None:
    """Write to a pipeline's target (``quarantine`` beside any of them names the
    folder for rows taken out): ``{"path"}`` a folder per run,
    ``{"table"}`` a catalog table, ``{"merge", "keys"}`` a versioned table
    merged by key, ``{"jdbc", "table"}`` or ``{"kafka", "topic"}``; none: the
    rows are only counted. Returns the path written, if there is one."""
    t = dict(target or {})
    t.pop("quarantine", None)
    if "path" in t:
        return sinks.write_run(df, t["path"], run_id, t.get("format", "parquet"),
                               t.get("mode", "overwrite"))
    if "merge" in t:
        order = [F.col(c) for c in t.get("order", [])]
        number = sinks.merge_into_path(t["merge"], df, t["keys"], order or None)
        return f"{t['merge']}/v={number}"
    if "jdbc" in t:
        sinks.write_jdbc(df, t.pop("jdbc"), t.pop("table"), t.pop("mode", "append"), **t)
    elif "table" in t:
        sinks.write_table(df, t["table"], t.get("mode", "append"), t.get("partition_by"))
    elif "kafka" in t:
        sinks.write_kafka(df, t["kafka"], t["topic"], t.get("key"))
    else:
        df.write.format("noop").mode("overwrite").save()
    return None


def run_streaming(spark: SparkSession, spec: PipelineSpec, checkpoint: str, kind: str = "batch",
                  schema=None, max_files_per_trigger: int | None = None,
                  interval: str = "60 seconds", frames: dict | None = None):
    """The same pipeline spec on a stream. The source folder is read as
    a file stream (new files become micro-batches), the incremental filter
    and the transform chain are applied unchanged (joins against the static
    ``frames``), row-level and reference rules flag rows inline (X7) and the
    result is appended to the target path; ``kind`` picks the trigger
    (batch = availableNow, micro_batch = processingTime, streaming = default).
    Rules that judge a set of rows (uniqueness, custom SQL, statistics) are
    evaluated per micro-batch into ``<target>_results``; this form writes
    each batch into its own folder of the target.
    Returns the started ``StreamingQuery``."""
    from quarry import streaming

    src = spec.source
    stream = streaming.file_stream(spark, src["path"], schema or src.get("schema"),
                                   src.get("format", "parquet"), max_files_per_trigger)
    if spec.incremental_column:
        stream = incremental_filter(stream, spec.incremental_column, spec.last_value)
    df = apply_transforms(stream, spec.transforms, frames)
    if spec.organization:
        df = ingest_metadata(df, spec.organization, spec.environment)
    target = spec.target or {}
    trig = {"interval": interval} if kind == "micro_batch" else {}
    inline, whole = streaming.split_rules(df, spec.rules, frames)
    if spec.rules:
        df = streaming.flag_stream(df, inline, frames=frames)
    if whole:
        judge = streaming.rules_batch_writer(whole, target["path"] + "_results", frames)

        def write(batch: DataFrame, batch_id: int) -> None:
            staged = cut_lineage(batch)
            judge(staged.drop("_failed_rules"), batch_id)
            staged.write.mode("overwrite").format(target.get("format", "parquet")) \
                .save(f"{target['path']}/batch_id={batch_id}")
            drop_written(spark, staged)

        return streaming.start(df, checkpoint, kind, foreach_batch=write, **trig)
    return streaming.start(df, checkpoint, kind, target.get("format", "parquet"),
                           path=target.get("path"), **trig)
