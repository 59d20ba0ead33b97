"""PII detection, masking and field encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

# PII classes and their patterns (written in the subset of
# regex syntax shared by Java and RE2 so SQL oracles can run them too).
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# Key fragments that mark a configuration value as sensitive.
SENSITIVE_KEY_PARTS = ("password", "token", "secret", "key")


# A literal every match of the class must contain; texts
# without it skip the (backtracking-heavy) regex entirely.
PII_REQUIRED = {"email": "@"}


def _guarded(c: Column, k: str, matched: Column, otherwise: Column) -> Column:
    need = PII_REQUIRED.get(k)
    return F.when(c.contains(need), matched).otherwise(otherwise) if need else matched


def pii_counts(c: Column) -> dict[str, Column]:
    """F20 detection: number of matches per class (``regexp_count``; no
    match arrays are built)."""
    return {k: _guarded(c, k, F.regexp_count(c, F.lit(p)), F.lit(0))
            for k, p in PII_PATTERNS.items()}


def mask_pii(c: Column, classes: list[str] | None = None) -> Column:
    """F20 masking: each match replaced by ``[CLASS]``."""
    out = c
    for k in classes or list(PII_PATTERNS):
        out = _guarded(out, k, F.regexp_replace(out, PII_PATTERNS[k], f"[{k.upper()}]"), out)
    return out


def is_sensitive_key(name: str) -> bool:
    n = name.lower()
    return any(p in n for p in SENSITIVE_KEY_PARTS)


def mask_sensitive(df: DataFrame, replacement: str = "***") -> DataFrame:
    """mask values whose name marks them sensitive - top-level string
    columns, nested struct fields (rebuilt with ``withField``) and map
    values (``transform_values`` on matching keys)."""
    out = df
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType) and is_sensitive_key(f.name):
            out = out.withColumn(f.name, F.when(col.isNotNull(), F.lit(replacement)))
        elif isinstance(f.dataType, StructType):
            out = out.withColumn(f.name, _mask_struct(col, f.dataType, replacement))
        elif isinstance(f.dataType, MapType) and isinstance(f.dataType.valueType, StringType):
            out = out.withColumn(f.name, F.transform_values(col, lambda k, v: F.when(
                _sensitive_key_col(k), F.lit(replacement)).otherwise(v)))
    return out


def _sensitive_key_col(k: Column) -> Column:
    lk = F.lower(k)
    cond = F.lit(False)
    for p in SENSITIVE_KEY_PARTS:
        cond = cond | lk.contains(p)
    return cond


def _mask_struct(col: Column, st: StructType, replacement: str) -> Column:
    out = col
    for f in st.fields:
        sub = col.getField(f.name)
        if isinstance(f.dataType, StringType) and is_sensitive_key(f.name):
            out = out.withField(f.name, F.when(sub.isNotNull(), F.lit(replacement)))
        elif isinstance(f.dataType, StructType):
            out = out.withField(f.name, _mask_struct(sub, f.dataType, replacement))
    return out


def encrypt(c: Column, key: Column | str) -> Column:
    """AES-GCM field encryption, base64 text; key supplied at run time."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.base64(F.aes_encrypt(c.cast("string"), k))


def decrypt(c: Column, key: Column | str) -> Column:
    k = F.lit(key) if isinstance(key, str) else key
    return F.aes_decrypt(F.unbase64(c), k).cast("string")
