"""Tenant scope (P13, G11): every read of a shared table goes through a
mandatory tenant filter (pushed into the scan; partition pruning when the
table is partitioned by the tenant column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TenantScope:
    def __init__(self, tenant_id: str, column: str = "organization_id",
                 active_column: str | None = "is_active"):
        self.tenant_id = tenant_id
        self.column = column
        self.active_column = active_column

    def read(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns:
            raise ValueError(f"table has no tenant column '{self.column}'")
        out = df.where(F.col(self.column) == F.lit(self.tenant_id))
        if self.active_column and self.active_column in df.columns:
            out = out.where(F.col(self.active_column))
        return out

    def frames(self, **tables: DataFrame) -> dict[str, DataFrame]:
        """Scoped frames to pass as ``spark.sql(q, **frames)`` arguments."""
        return {k: self.read(v) for k, v in tables.items()}


def leaks(df: DataFrame, tenant_id: str, column: str = "organization_id") -> DataFrame:
    """Rows of other tenants in a tenant's result (must be empty)."""
    return df.where(F.col(column).isNull() | (F.col(column) != F.lit(tenant_id)))
