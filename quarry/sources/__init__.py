"""Source registry (S21): connector name -> reader function.

Custom connectors register a callable ``(spark, **options) -> DataFrame`` or,
for Python ``DataSource`` classes, are registered with
``spark.dataSource.register`` and read by their short name (E5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import external, files

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    _REGISTRY[name.lower()] = reader


def get(name: str) -> Callable[..., DataFrame]:
    try:
        return _REGISTRY[name.lower()]
    except KeyError:
        raise KeyError(f"unknown connector: {name}") from None


def list_connectors() -> list[str]:
    return sorted(_REGISTRY)


def create(spark: SparkSession, name: str, **options) -> DataFrame:
    return get(name)(spark, **options)


def register_datasource(spark: SparkSession, cls) -> None:
    """E5: a ``pyspark.sql.datasource.DataSource`` subclass becomes a format."""
    spark.dataSource.register(cls)
    register(cls.name(), lambda s, **o: s.read.format(cls.name()).options(**o).load())


# Built-in connector names (fixed values: the six connectors with code).
register("postgresql", lambda s, **o: external.jdbc_read(s, **o))
register("mysql", lambda s, **o: external.jdbc_read(s, **o))
register("s3", lambda s, path, fmt=None, **o: (files.scan_prefix(s, path, fmt, **o) if fmt
                                                else files.read_by_suffix(s, path, **o)))
register("kafka", lambda s, **o: external.kafka_batch_read(s, **o))
register("mongodb", lambda s, **o: external.document_read(s, **o))
register("snowflake", lambda s, **o: external.snowflake_read(s, **o))
register("file", lambda s, path, fmt="parquet", **o: files.scan_file(s, path, fmt, **o))
register("delta", lambda s, path: external.delta_read(s, path))
register("table", lambda s, name, **o: external.lakehouse_table(s, name, **o))
