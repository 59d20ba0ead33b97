"""File-based sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Formats accepted by the pipeline scan and the suffix reader.
PIPELINE_FORMATS = ("parquet", "csv", "json")
DECLARED_FORMATS = ("json", "csv", "parquet", "avro", "orc", "delimited", "xml", "binary")
SUFFIX_FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


class SourceError(ValueError):
    pass


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one supplied table ``{base}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def scan_file(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None,
              infer_schema: bool = False, options: dict | None = None) -> DataFrame:
    """Scan by format; csv gets a header. Unknown formats raise."""
    fmt = fmt.lower()
    if fmt not in PIPELINE_FORMATS:
        raise SourceError(f"unsupported file format: {fmt}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer_schema and fmt in ("csv", "json"):
        reader = reader.option("inferSchema", True)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load(path)


def scan_format(spark: SparkSession, path: str, fmt: str, schema=None,
                options: dict | None = None) -> DataFrame:
    """Every declared format through Spark's own readers.

    ``delimited`` is csv with a separator; ``binary`` is the binaryFile
    source; ``avro`` and ``xml`` are used when their reader resolves.
    """
    fmt = fmt.lower()
    if fmt not in DECLARED_FORMATS:
        raise SourceError(f"unsupported format: {fmt}")
    opts = dict(options or {})
    spark_fmt = {"delimited": "csv", "binary": "binaryFile"}.get(fmt, fmt)
    if fmt == "delimited":
        opts.setdefault("sep", "|")
        opts.setdefault("header", "true")
    reader = spark.read.format(spark_fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def scan_prefix(spark: SparkSession, uri: str, fmt: str = "parquet", schema=None,
                credentials: dict | None = None) -> DataFrame:
    """S3: scan every object under a prefix of any Hadoop file system URI.

    Credentials (for s3a) are set on the Hadoop configuration of this session
    only when given.
    """
    if credentials:
        hconf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in credentials.items():
            hconf.set(k, v)
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(uri)


def read_by_suffix(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Pick the reader from the object's extension (.csv/.json/.parquet)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SUFFIX_FORMATS:
        raise SourceError(f"unsupported file type: {ext or path}")
    fmt = SUFFIX_FORMATS[ext]
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def list_objects(spark: SparkSession, uri: str, glob: str | None = None) -> DataFrame:
    """Object listing (key, size, last_modified) without reading content.

    ``content`` is pruned away by the projection, so the binaryFile source
    only lists file status.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (reader.load(uri)
            .select(F.col("path").alias("key"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("last_modified"),
                    F.lit("STANDARD").alias("storage_class")))


def tenant_dataset_path(bucket: str, tenant: str, dataset: str) -> str:
    """``{bucket}/{tenant}/datasets/{name}.csv``."""
    return os.path.join(bucket, tenant, "datasets", f"{dataset}.csv")


def read_tenant_dataset(spark: SparkSession, bucket: str, tenant: str, dataset: str,
                        schema=None) -> DataFrame | None:
    """Dataset by name inside a tenant's storage; ``None`` when missing."""
    path = tenant_dataset_path(bucket, tenant, dataset)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return None
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def single_record(spark: SparkSession, record: dict, schema=None) -> DataFrame:
    """One record (real-time check) as a one-row DataFrame."""
    if schema is None:
        return spark.createDataFrame([record])
    return spark.createDataFrame([tuple(record.get(f.name) for f in schema.fields)], schema)


def scan_tables(spark: SparkSession, base: str, tables: list[str], fmt: str = "parquet",
                incremental_column: str | None = None, last_values: dict | None = None) -> dict:
    """One DataFrame per listed table, each with the incremental filter."""
    from quarry.operators.transforms import incremental_filter

    out = {}
    for t in tables:
        df = spark.read.format(fmt).load(os.path.join(base, f"{t}.{fmt}"))
        if incremental_column:
            df = incremental_filter(df, incremental_column, (last_values or {}).get(t))
        out[t] = df
    return out
