"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_forwarded_ip(c: Column) -> Column:
    """first address of an ``X-Forwarded-For`` list, trimmed."""
    return F.trim(F.split_part(c, F.lit(","), F.lit(1)))


def search_score(query: str, name: Column, description: Column | None = None) -> Column:
    """1.0 exact name / 0.8 name contains, +0.3 description contains,
    +0.5 name prefix; capped at 1.0. Case-insensitive."""
    q = F.lit(query.lower())
    n = F.lower(name)
    s = F.when(n == q, 1.0).when(n.contains(q), 0.8).otherwise(0.0)
    if description is not None:
        s = s + F.when(F.coalesce(F.lower(description).contains(q), F.lit(False)), 0.3)\
            .otherwise(0.0)
    s = s + F.when(n.startswith(q), 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), s)


def render_template(template: str, values: dict[str, Column]) -> Column:
    """``{{var}}`` placeholders replaced by column values."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def ilike_any(columns: list[str], term: str) -> Column:
    """Case-insensitive ``%term%`` on any of the columns."""
    pat = f"%{term}%"
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(pat), F.lit(False))
    return cond
