"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE for runtime re-planning (partition
# coalescing, skew-join splitting, runtime broadcast conversion based on
# *measured* shuffle sizes), UTC session time, last-wins map merging.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "quarry",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, conf[k])
    return spark


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """Sizing for a large cluster: enough initial shuffle partitions that
    each holds about ``target_partition_bytes`` of the input (AQE then
    coalesces small ones and splits skewed ones), never fewer than two
    waves of tasks; scan splits of 256 MB."""
    slots = executors * cores_per_executor
    parts = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 ** 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes":
            str(4 * target_partition_bytes),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session (it is a core setting:
    cluster defaults or ``--conf``). Where nothing is configured, a local
    master (tests) gets a private folder; on a cluster, whose machines would
    not share such a folder, that is an error.
    """
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder "
                           "that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result of an iterative operator.

    The frame is written once as parquet into a fresh folder under the
    shared ``spark.checkpoint.dir`` and read back, so a lost executor
    recomputes from that table rather than from the start of the loop.
    (An RDD ``checkpoint()`` of an unpersisted frame would compute it twice:
    once for the action and once more to write the checkpoint files.)
    """
    spark = df.sparkSession
    path = _new_table(spark)
    df.write.mode("errorifexists").parquet(path)
    return _read_back(spark, path)


_OPEN = threading.local()  # tables made in each open ``scratch`` of this thread


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def _new_table(spark: SparkSession) -> str:
    """A fresh table's folder. It goes with the application at the latest."""
    path = os.path.join(checkpoint_dir(spark), f"quarry-{uuid.uuid4().hex}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    for made in getattr(_OPEN, "scratches", []):
        made.append(path)
    return path


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df._written = path
    return df


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``cut_lineage`` writes inside this block are dropped at its end,
    all but those that were given to the function that the block gets."""
    made, kept = [], []
    _OPEN.scratches = [*getattr(_OPEN, "scratches", []), made]
    try:
        yield lambda df: kept.append(df._written)
    finally:
        _OPEN.scratches = _OPEN.scratches[:-1]
        for path in made:
            if path not in kept:
                _delete(spark, path)


_LENIENT = threading.RLock()


@contextmanager
def lenient(spark: SparkSession):
    """Expressions put into a plan inside this block give null where ANSI mode
    would raise (division by zero, a cast that fails, an index out of range).
    A plan keeps the mode that it was made under; the block only makes plans,
    one thread at a time, and puts the setting back."""
    with _LENIENT:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder behind a frame returned by ``cut_lineage`` once no
    later plan reads it (iterative operators free their finished levels)."""
    if path := getattr(df, "_written", None):
        _delete(spark, path)


def cut_lineage_counting(df: DataFrame, condition) -> tuple[DataFrame, int]:
    """``cut_lineage`` that also counts the rows matching ``condition`` while
    the table is written (an observed metric: no second job)."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    obs = Observation(f"cut_{uuid.uuid4().hex[:12]}")
    path = _new_table(spark)
    df.observe(obs, F.count_if(condition).alias("n")).write.mode("errorifexists").parquet(path)
    return _read_back(spark, path), int(obs.get["n"] or 0)
