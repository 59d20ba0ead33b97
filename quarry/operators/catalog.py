"""Catalog operations: search, schemas, tables, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.text import search_score


def search(df: DataFrame, query: str, name: str, description: str | None = None,
           limit: int = 20, tiebreak: str | None = None) -> DataFrame:
    """T5: relevance-ranked search, sorted globally then limited (top-k)."""
    score = search_score(query, F.col(name), F.col(description) if description else None)
    order = [F.col("score").desc(), F.col(name).asc()]
    if tiebreak:
        order.append(F.col(tiebreak).asc())
    return (df.withColumn("score", score).where(F.col("score") > 0)
            .orderBy(*order).limit(limit))


def _text(v) -> str:
    """A SQL string literal."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(v: str) -> str:
    """A quoted identifier; dots part the levels of a name."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in v.split("."))


def create_schema(spark: SparkSession, name: str, comment: str | None = None,
                  properties: dict | None = None, location: str | None = None) -> None:
    """K8."""
    q = f"CREATE SCHEMA IF NOT EXISTS {_name(name)}"
    if comment:
        q += f" COMMENT {_text(comment)}"
    if location:
        q += f" LOCATION {_text(location)}"
    if properties:
        props = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items())
        q += f" WITH DBPROPERTIES ({props})"
    spark.sql(q)


def create_table(spark: SparkSession, name: str, schema: StructType,
                 partition_columns: list[str] | None = None, comment: str | None = None,
                 path: str | None = None, fmt: str = "parquet",
                 properties: dict | None = None) -> None:
    """K9: declared columns (nullability, comments), partition keys and
    properties; managed table, or external when ``path`` is given."""
    cols = []
    for f in schema.fields:
        c = "`" + f.name.replace("`", "``") + f"` {f.dataType.simpleString()}"
        if not f.nullable:
            c += " NOT NULL"
        if f.metadata.get("comment"):
            c += f" COMMENT {_text(f.metadata['comment'])}"
        cols.append(c)
    if not fmt.isidentifier():
        raise ValueError(f"no format: {fmt}")
    q = f"CREATE TABLE IF NOT EXISTS {_name(name)} ({', '.join(cols)}) USING {fmt}"
    if partition_columns:
        q += f" PARTITIONED BY ({', '.join(map(_name, partition_columns))})"
    if path:
        q += f" LOCATION {_text(path)}"
    if comment:
        q += f" COMMENT {_text(comment)}"
    if properties:
        q += " TBLPROPERTIES (" + ", ".join(f"{_text(k)} = {_text(v)}"
                                            for k, v in properties.items()) + ")"
    spark.sql(q)


def analyze(spark: SparkSession, table: str) -> None:
    """K12 (stats half): table and column statistics for the cost model."""
    spark.sql(f"ANALYZE TABLE {_name(table)} COMPUTE STATISTICS FOR ALL COLUMNS")


def compact(spark: SparkSession, path: str, file_bytes: int = 128 * 1024 ** 2) -> int:
    """K12 (compaction half) of a versioned table: its newest version is
    rewritten with files of about ``file_bytes`` as the next version. The
    old one stays readable until the new one is finished, and a failed
    rewrite leaves it as it was."""
    from quarry import sinks

    now = sinks.read_version(spark, path)
    fs, folder = sinks._fs(spark, f"{path}/v={sinks.versions(spark, path)[-1]}")
    size = fs.getContentSummary(folder).getLength()
    return sinks.publish_version(now.repartition(max(1, -(-size // file_bytes))), path)


def snapshots(spark: SparkSession, base: str) -> DataFrame:
    """Run-id directories written by per-run sinks, with size and time."""
    from quarry.sources.files import list_objects

    import os
    import re

    anchor = re.escape(os.path.basename(base.rstrip("/")))
    return (list_objects(spark, base)
            .withColumn("snapshot_id", F.regexp_extract("key", anchor + r"/([^/]+)/", 1))
            .where((F.col("snapshot_id") != "") & ~F.col("snapshot_id").startswith("_"))
            .groupBy("snapshot_id")
            .agg(F.sum("size").alias("size_bytes"), F.count(F.lit(1)).alias("files"),
                 F.max("last_modified").alias("committed_at")))
