"""End-to-end quality check (3.2): select the tenant's rules -> one fused
pass over the dataset -> route failures (alerts, incidents, reject) ->
score -> append results.

Rules are configuration rows; they are collected (a bounded, tiny set) only
to compile the plan. The dataset is never collected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import monitoring, remediate
from quarry.operators.quality import rule_from_row, run_rules, select_rules


def run_quality_check(spark: SparkSession, rules_table: DataFrame, dataset: DataFrame,
                      organization_id: str, dataset_name: str, batch_id: str,
                      frames: dict | None = None, as_of=None, executed_at=None,
                      results_path: str | None = None) -> dict[str, DataFrame]:
    """Returns ``results``, ``alerts``, ``incidents``, ``batch`` (reject
    decision) and ``score`` frames; appends results partitioned by tenant and
    run date when ``results_path`` is given (K11)."""
    selected = select_rules(rules_table, organization_id, dataset_name)
    rules = [rule_from_row(r) for r in selected.collect()]
    executed_at = executed_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    ctx = {"organization_id": organization_id, "dataset_name": dataset_name,
           "batch_id": batch_id, "executed_at": executed_at}
    results = run_rules(dataset, rules, frames, as_of, ctx, isolate_runtime_errors=True)
    routed = remediate.route(results, selected)
    out = {
        "results": results,
        "alerts": remediate.alerts(routed),
        "incidents": remediate.incidents(routed),
        "batch": remediate.reject_batch(results, routed),
        "score": monitoring.overall_score(results, ["organization_id", "dataset_name",
                                                    "batch_id"]),
    }
    if results_path:
        (results.withColumn("run_date", F.to_date("executed_at"))
         .write.mode("append").partitionBy("organization_id", "run_date").parquet(results_path))
    return out
