"""Every query with a SQL twin gives DuckDB's rows."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op"))


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return int(x) if isinstance(x, int) else str(x)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    expected = Counter(tuple(value(x) for x in r) for r in want.fetchall())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
