"""Every SQL-expressible query against DuckDB on the same tables.

ORACLE_SF_DIR chooses the tables (the smallest by default).
"""

import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tidewright.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    yield con
    con.close()


def plain(x):
    """A value that both engines render alike."""
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, date) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    want = duck.sql(SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == names
    rows = Counter(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    other = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert rows == other, (list((rows - other).items())[:3], list((other - rows).items())[:3])


#: Tested by values, against brute force.
BY_VALUE = {"c17", "c18", "c19", "i1", "j7", "c20", "c21", "c32", "d9", "e5", "h4", "h5", "h6", "h7_token", "h8", "h10", "i2", "j3", "j4", "j11", "i3", "i6", "i7"}
BY_VALUE |= {"i4_observation", "i5_source", "i8", "i9", "i10", "i11", "i12", "i13", "i16", "i17", "i18", "c22", "c26", "l6", "h13", "a11", "d5", "e20"}


def test_every_query_is_checked():
    rest = set(QUERIES) - set(SQL)
    assert all(any(q.startswith(k + "_") for k in BY_VALUE) for q in rest), rest
