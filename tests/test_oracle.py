"""Every registered query against its SQL oracle (DuckDB) on sf0.01."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from quarry.plans import suite
from conftest import SF01

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.8g}")
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def _close(a, b):
    return all((isinstance(p, float) and isinstance(q, float)
                and math.isclose(p, q, rel_tol=1e-7, abs_tol=1e-9)) or p == q
               for p, q in zip(a, b))


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    a, b = _rows(df.columns, srows), _rows(dcols, drows)
    assert len(a) == len(b)
    assert all(_close(x, y) for x, y in zip(a, b))


def test_every_query_has_oracle_or_is_listed():
    assert set(suite.QUERIES) == set(suite.SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "status" in df.columns
