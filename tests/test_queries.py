"""Every query runs on the smallest tables, and equals its SQL where there is one."""

import os
from collections import Counter

import duckdb
import pytest

from petrel.plans import archive, dealt

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
QUERIES = archive.QUERIES | dealt.QUERIES
SQL = archive.SQL | dealt.SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in os.listdir(D):
        con.execute(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name in SQL:
        got = db.execute(SQL[name])
        at = [[c[0] for c in got.description].index(c) for c in columns]
        assert rows == Counter(tuple(str(r[i]) for i in at) for r in got.fetchall())
    else:
        assert rows
