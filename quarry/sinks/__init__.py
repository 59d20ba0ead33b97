"""Sinks (K1-K7, K10, K11, K14)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_run(df: DataFrame, base: str, run_id: str, fmt: str = "parquet",
              mode: str = "overwrite") -> str:
    """K1: one directory per run id; the run directory is the snapshot."""
    path = os.path.join(base, str(run_id))
    df.write.mode(mode).format(fmt).save(path)
    return path


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append",
                partition_by: list[str] | None = None, rebalance: bool = False) -> None:
    """File write with a mode; ``partition_by`` for tenant/date
    layouts. ``rebalance`` adds a REBALANCE by the partition columns so each
    output partition gets evenly sized files (skew-aware under AQE)."""
    if rebalance:
        df = df.hint("rebalance", *(partition_by or []))
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite",
               batch_size: int = 10000, num_partitions: int | None = None, **conn) -> None:
    """K3: JDBC write; parallelism capped by ``num_partitions`` connections."""
    w = (df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
         .option("batchsize", batch_size))
    if num_partitions:
        w = w.option("numPartitions", num_partitions)
    for k, v in conn.items():
        w = w.option(k, v)
    w.save()


def kafka_payload(df: DataFrame, key: str | None = None) -> DataFrame:
    """K4: every row as a JSON ``value`` (and optional ``key``)."""
    cols = [F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def write_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    """K4 (batch). For streams use ``writeStream`` with the same payload."""
    (kafka_payload(df, key).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """K5: documents as JSON lines (MongoDB connector when present)."""
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, table: str, mode: str = "append",
                partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """K6: managed/catalog table write; overwrite replaces only the written
    partitions (dynamic partition overwrite, an option of this write alone).
    Columns go to the table's columns by name; a missing or unknown one is an
    error."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table) and mode in ("append", "overwrite"):
        wanted = spark.table(table).columns
        odd = set(map(str.lower, wanted)) ^ set(map(str.lower, df.columns))
        if odd:
            raise ValueError(f"columns of the frame and of {table} differ: {sorted(odd)}")
        df.select(*(F.col(f"`{c}`") for c in wanted)).write \
            .option("partitionOverwriteMode", "dynamic") \
            .insertInto(table, overwrite=(mode == "overwrite"))
        return
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table)


def merge_frames(target: DataFrame, source: DataFrame, keys: list[str],
                 order: list[Column] | None = None, delete_col: str | None = None) -> DataFrame:
    """K7/X9 on plain files: the merged image of ``target`` after upserting
    ``source``. Within the source the last row per key wins (``order``);
    source rows replace target rows with the same key (``left_anti`` +
    ``unionByName``); rows flagged by ``delete_col`` remove the key.

    Both sides shuffle once on the key; a hot key is reduced by the
    partial ``max_by`` before the shuffle."""
    src = source
    if order:
        rest = [c for c in source.columns if c not in keys]
        src = (source.groupBy(*keys)
               .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
               .select(*keys, "__r.*"))
    kept = target.join(src.select(*keys), keys, "left_anti")
    upserts = src
    if delete_col:
        upserts = src.where(~F.coalesce(F.col(delete_col), F.lit(False))).drop(delete_col)
    return kept.unionByName(upserts, allowMissingColumns=True)


def _fs(spark, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def versions(spark, path: str) -> list[int]:
    """Finished versions (folders ``v=<n>`` with a ``_SUCCESS`` mark) of a
    versioned table, in order."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    found = [s.getPath() for s in fs.listStatus(jpath) if s.getPath().getName().startswith("v=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(done(p, "_SUCCESS")))


def read_version(spark, path: str, version: int | None = None) -> DataFrame:
    """The newest finished version of a versioned table, or a given one."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no finished version")
    return spark.read.parquet(os.path.join(path, f"v={found[-1] if version is None else version}"))


def publish_version(df: DataFrame, path: str) -> int:
    """Write a frame as the next version. The ``_SUCCESS`` mark of the new
    folder is what publishes it: readers see the old version or the new one,
    and a write that failed half-way is never read."""
    found = versions(df.sparkSession, path)
    number = found[-1] + 1 if found else 0
    df.write.mode("overwrite").parquet(os.path.join(path, f"v={number}"))
    return number


def merge_into_path(path: str, source: DataFrame, keys: list[str],
                    order: list[Column] | None = None, delete_col: str | None = None) -> int:
    """K7 on a versioned table: the merged image of the newest version and
    ``source`` becomes the next version, which later merges start from."""
    spark = source.sparkSession
    current = read_version(spark, path) if versions(spark, path) else \
        source.drop(*([delete_col] if delete_col else [])).limit(0)
    return publish_version(merge_frames(current, source, keys, order, delete_col), path)


def write_report(results: DataFrame, base: str, stamp: str) -> str:
    """Quality report as JSON under a timestamped path."""
    path = os.path.join(base, f"quality_report_{stamp}")
    results.coalesce(1).write.mode("overwrite").json(path)
    return path


def dead_letters(df: DataFrame, failed_flag: str = "_failed_rules",
                 corrupt_col: str = "_corrupt") -> DataFrame:
    """Rows set aside - failed quality checks or unparsable payloads."""
    cond = F.lit(False)
    if failed_flag in df.columns:
        cond = cond | (F.size(failed_flag) > 0)
    if corrupt_col in df.columns:
        cond = cond | F.col(corrupt_col).isNotNull()
    return df.where(cond)
