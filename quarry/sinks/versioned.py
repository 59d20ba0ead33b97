"""Versioned keyed tables on plain files.

A table is a folder of data folders and manifests. Manifest ``n`` (a small JSON
file) is version n: which data folder holds each *leaf* of the key space, with its
rows, and the last batch that each writer has applied. Rows go to leaves by the
leading bits of their key's hash; a leaf that outgrows ``leaf_rows`` is split into
the two (or more) leaves of further bits by the update that makes it so, and every
other leaf keeps its folder. An update reads and writes the touched leaves only.

* *Publishing.* An update writes its data folders under fresh names, then puts the
  manifest of the next number in place by a rename that fails if that number is
  there: of two writers one wins, and the other starts over from the new version.
  A manifest is complete before it is renamed, so readers see whole versions.
* *Exactly once.* An update may carry its writer's name and batch number; a batch
  that a version already holds is not applied again.
* *Expiry.* ``expire`` drops manifests before the last ``keep`` and the data folders
  that no kept manifest names and that are older than ``grace_seconds``, so readers
  of a kept version, and writers at work, keep their files.

Key columns may hold nulls. Rows of one key always lie in one leaf.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import cut_lineage, drop_written
from quarry.sinks import _fs

HASH_BITS = 40
LEAF_ROWS = 2_000_000
LEAF, ROOT = "_leaf", "d0_0"
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer published the version first."""


def _manifests(path: str) -> str:
    return os.path.join(path, "_manifests")


def history(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, in order."""
    fs, folder = _fs(spark, _manifests(path))
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    fs, file = _fs(spark, os.path.join(_manifests(path), f"{version}.json"))
    stream = fs.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    """Put a manifest in place, unless its number is taken."""
    fs, folder = _fs(spark, _manifests(path))
    fs.mkdirs(folder)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = jvm.org.apache.hadoop.fs.Path
    tmp = path_of(folder, f"tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    none = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(tmp, path_of(folder, f"{content['version']}.json"), none)
    except Exception as e:
        fs.delete(tmp, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {content['version']} of {path} is taken") from None
        raise


def _hash(keys: list[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), 64 - HASH_BITS)


def _leaf(depth: Column | int, hashed: Column) -> Column:
    """Name of the leaf of so many leading bits: ``d<depth>_<bits>``."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    bits = F.floor(hashed / F.pow(F.lit(2.0), F.lit(HASH_BITS) - depth)).cast("long")
    return F.concat(F.lit("d"), depth.cast("int").cast("string"), F.lit("_"), bits.cast("string"))


def _place(name: str) -> tuple[int, int]:
    depth, bits = name[1:].split("_")
    return int(depth), int(bits)


def _placed(rows: DataFrame, keys: list[str], leaves: dict) -> DataFrame:
    """Rows with the name of the leaf that they belong to. Leaves have few depths,
    and of each depth a row can only be in one."""
    depths = sorted({_place(name)[0] for name in leaves})
    if depths == [0]:
        return rows.withColumn(LEAF, F.lit(ROOT))
    names = rows.sparkSession.createDataFrame([(n,) for n in leaves], f"{LEAF} string")
    tried = F.array(*(_leaf(d, _hash(keys)) for d in depths))
    return rows.withColumn(LEAF, F.explode(tried)).join(names, LEAF, "left_semi") \
        .select(*rows.columns, LEAF)


def _data(spark: SparkSession, path: str, leaves: dict) -> DataFrame | None:
    folders = sorted({v["folder"] for v in leaves.values() if v})
    if not folders:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*(os.path.join(path, f) for f in folders))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of a given one."""
    found = history(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no version")
    content = manifest(spark, path, found[-1] if version is None else version)
    out = _data(spark, path, content["leaves"])
    if out is None:
        return spark.createDataFrame([], content["schema"])
    return out


def update(spark: SparkSession, path: str, source: DataFrame, keys: list[str],
           combine: Callable[[DataFrame | None, DataFrame], DataFrame],
           writer: str | None = None, batch: int | None = None,
           leaf_rows: int = LEAF_ROWS) -> int:
    """Publish the next version, in which the leaves that ``source`` touches hold
    ``combine(their rows or None, source)`` (of both, only rows of these leaves).
    Returns the version that holds the batch."""
    staged = cut_lineage(source)
    try:
        for _ in range(ATTEMPTS):
            try:
                return _try_update(spark, path, staged, keys, combine, writer, batch, leaf_rows)
            except Conflict:
                continue
        raise Conflict(f"{path}: {ATTEMPTS} versions were taken by other writers")
    finally:
        drop_written(spark, staged)


def _try_update(spark, path, source, keys, combine, writer, batch, leaf_rows) -> int:
    found = history(spark, path)
    old = manifest(spark, path, found[-1]) if found else \
        {"version": -1, "leaves": {ROOT: None}, "batches": {}, "schema": None}
    if writer is not None and old["batches"].get(writer, -1) >= batch:
        return old["version"]
    placed = _placed(source, keys, old["leaves"])
    # as many names as the touched leaves
    new_rows = {r[LEAF]: r.n for r in placed.groupBy(LEAF).agg(F.count(F.lit(1)).alias("n"))
                .collect()}
    held = {n: v for n, v in old["leaves"].items() if v and n in new_rows}
    rows = combine(_data(spark, path, held), source)
    # a leaf that may outgrow its size goes to leaves of more bits at once
    split = {}
    for name, n in new_rows.items():
        depth, extra = _place(name)[0], 0
        total = n + (old["leaves"][name] or {"rows": 0})["rows"]
        while total > leaf_rows << extra and depth + extra < HASH_BITS:
            extra += 1
        split[name] = depth + extra
    by_depth = spark.createDataFrame([(n, d) for n, d in split.items()], f"{LEAF} string, _depth int")
    out = _placed(rows, keys, old["leaves"]).join(by_depth, LEAF) \
        .withColumn(LEAF, _leaf(F.col("_depth"), _hash(keys))).drop("_depth")
    folder = f"data-{uuid.uuid4().hex}"
    # one task per leaf writes one file of at most a few leaves' rows
    out.repartition(F.col(LEAF)).write.partitionBy(LEAF).parquet(os.path.join(path, folder))
    written = spark.read.parquet(os.path.join(path, folder)) if _has_rows(spark, path, folder) else None
    leaves = {n: v for n, v in old["leaves"].items() if n not in new_rows}
    if written is not None:
        for r in written.groupBy(F.col(LEAF).cast("string").alias(LEAF)) \
                .agg(F.count(F.lit(1)).alias("n")).collect():
            leaves[r[LEAF]] = {"folder": f"{folder}/{LEAF}={r[LEAF]}", "rows": r.n}
    # leaves that are empty now still stand for their part of the key space
    for name, depth in split.items():
        at, bits = _place(name)
        for b in range(bits << (depth - at), (bits + 1) << (depth - at)):
            leaves.setdefault(f"d{depth}_{b}", None)
    batches = dict(old["batches"]) | ({writer: batch} if writer is not None else {})
    _publish(spark, path, {"version": old["version"] + 1, "leaves": leaves, "batches": batches,
                           "schema": rows.schema.simpleString()})
    return old["version"] + 1


def _has_rows(spark: SparkSession, path: str, folder: str) -> bool:
    fs, where = _fs(spark, os.path.join(path, folder))
    return any(s.isDirectory() for s in fs.listStatus(where))


def merge(spark: SparkSession, path: str, source: DataFrame, keys: list[str],
          order: list[Column] | None = None, delete_col: str | None = None, **options) -> int:
    """K7: upsert ``source`` by key as the next version (see ``sinks.merge_frames``)."""
    from quarry.sinks import merge_frames

    def combine(current: DataFrame | None, new: DataFrame) -> DataFrame:
        if current is None:
            current = new.drop(*([delete_col] if delete_col else [])).limit(0)
        return merge_frames(current, new, keys, order, delete_col)
    return update(spark, path, source, keys, combine, **options)


def expire(spark: SparkSession, path: str, keep: int = 2, grace_seconds: float = 3600) -> list[str]:
    """Drop all but the last ``keep`` versions; returns the data folders deleted."""
    found = history(spark, path)
    kept = [manifest(spark, path, v) for v in found[-keep:]]
    named = {v["folder"].split("/")[0] for m in kept for v in m["leaves"].values() if v}
    fs, base = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for v in found[:-keep]:
        fs.delete(path_of(_manifests(path), f"{v}.json"), False)
    gone, now = [], time.time()
    for s in fs.listStatus(base):
        name = s.getPath().getName()
        if name.startswith("data-") and name not in named and \
                now - s.getModificationTime() / 1000 >= grace_seconds:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone
