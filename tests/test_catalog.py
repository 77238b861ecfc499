"""Every registered query of the library runs on the smallest tables and agrees with its SQL."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from pairloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")


def plain(v):
    if isinstance(v, Decimal):
        return int(v) if v == int(v) else round(float(v), 6)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = df.collect()
    assert got
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        rows = lambda records: sorted(str([plain(r[n]) for n in names]) for r in records)
        assert rows(r.asDict() for r in got) == rows(dict(zip(want.columns, r)) for r in want.fetchall())
