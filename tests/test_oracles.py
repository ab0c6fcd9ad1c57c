"""Every query that has SQL gives the same rows by DuckDB; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans.catalogue import ORACLE_SQL, QUERIES


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "item"):
        return _plain(v.item())
    if v is None or v != v:
        return None
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    out = QUERIES[name](spark, sf)
    rows = out.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(out.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in rows), key=repr) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
