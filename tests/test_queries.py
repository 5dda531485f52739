"""Every query of the core against its SQL in DuckDB on the small tables; those without SQL must give rows."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from tidewright import catalog


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, data, con):
    df = catalog.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    r = con.execute(catalog.SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert got == Counter(tuple(plain(x[i]) for i in order) for x in r.fetchall())
