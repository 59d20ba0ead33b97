"""Preview and schema discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def preview(df: DataFrame, n: int = 100, with_count: bool = False) -> dict:
    """First ``n`` rows, column types and (optionally) the row count.

    The rows are a bounded ``limit`` (CollectLimit), never the whole table.
    ``total_count`` is ``None`` unless asked for, as counting is a full scan.
    """
    rows = [r.asDict(recursive=True) for r in df.limit(n).collect()]
    return {
        "columns": [{"name": c, "type": t} for c, t in df.dtypes],
        "rows": rows,
        "total_count": df.count() if with_count else None,
    }


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables joined to their columns, ordered by table and position.

    Uses the session catalog (``SHOW TABLES`` + ``DESCRIBE``-free listing via
    ``spark.catalog``). The join key includes the database, not only the
    table name.
    """
    db = database or spark.catalog.currentDatabase()
    tables = [t for t in spark.catalog.listTables(db) if not t.isTemporary]
    rows = []
    for t in tables:
        for pos, c in enumerate(spark.catalog.listColumns(t.name, db)):
            rows.append((db, t.name, c.name, c.dataType, c.nullable, None, pos + 1,
                         c.isPartition))
    schema = ("table_schema string, table_name string, column_name string, data_type string, "
              "is_nullable boolean, column_default string, ordinal_position int, "
              "is_partition boolean")
    cols = spark.createDataFrame(rows, schema)
    tabs = spark.createDataFrame([(db, t.name, t.tableType) for t in tables],
                                 "table_schema string, table_name string, table_type string")
    return (tabs.join(cols, ["table_schema", "table_name"], "inner")
            .orderBy("table_name", "ordinal_position"))


def jdbc_columns(spark: SparkSession, url: str, schema: str = "public", **conn) -> DataFrame:
    """S18 over JDBC: ``information_schema.tables`` ⋈ ``columns``; both reads
    push the schema filter into the remote query."""
    from quarry.sources.external import jdbc_read

    t = jdbc_read(spark, url, table="information_schema.tables", **conn)
    c = jdbc_read(spark, url, table="information_schema.columns", **conn)
    t = t.filter((F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE"))
    c = c.filter(F.col("table_schema") == schema)
    return (t.select("table_schema", "table_name")
            .join(c.select("table_schema", "table_name", "column_name", "data_type",
                           "is_nullable", "column_default", "ordinal_position"),
                  ["table_schema", "table_name"], "inner")
            .orderBy("table_name", "ordinal_position"))


def json_type_name(v) -> F.Column:
    """Coarse JSON type of a variant value (integer/double/string/boolean/
    object/array/null), from ``schema_of_variant``."""
    s = F.upper(F.schema_of_variant(v))
    return (F.when(s.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT)$"), "integer")
            .when(s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
            .when(s.rlike(r"^(DECIMAL|DOUBLE|FLOAT)"), "double")
            .when(s == "STRING", "string")
            .when(s == "BOOLEAN", "boolean")
            .when(s.startswith("OBJECT"), "object")
            .when(s.startswith("ARRAY"), "array")
            .when(s == "VOID", "null")
            .otherwise(F.lower(s)))


def infer_document_schema(df: DataFrame, json_col: str, sample_fraction: float | None = None,
                          seed: int = 7) -> DataFrame:
    """Per top-level field, the *set* of observed JSON types and the
    number of documents carrying it. Whole table by default; sampling is
    available only as an explicit ``sample_fraction``.

    ``collect_set`` of a type name per field is partially aggregated map-side,
    so even a field present in every document costs one small row per task.
    """
    src = df.sample(fraction=sample_fraction, seed=seed) if sample_fraction else df
    kv = (src.select(F.try_parse_json(F.col(json_col)).alias("v"))
          .where(F.col("v").isNotNull())
          .select(F.explode(F.try_variant_get("v", "$", "map<string,variant>"))
                  .alias("key", "value")))
    return (kv.where(F.col("key").isNotNull())
            .select(F.col("key").alias("field"), json_type_name(F.col("value")).alias("t"))
            .groupBy("field")
            .agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("types"),
                 F.count(F.lit(1)).alias("n_docs")))


def infer_message_schema(df: DataFrame, value_col: str = "value") -> str:
    """One merged schema for JSON messages (``schema_of_variant_agg``)."""
    row = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(value_col))
                                            ).alias("s")).first()
    return row["s"] if row else None
