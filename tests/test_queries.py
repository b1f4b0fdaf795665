"""Every registered query against its SQL, by value."""

from decimal import Decimal

import duckdb
import pytest

from textmill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, (float, Decimal)) else v


def rows_of(names, rows):
    return sorted((tuple(plain(r[n]) for n in names) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = rows_of(names, df.collect())
    assert got
    if name in registry.ORACLE:
        out = duck.sql(registry.ORACLE[name])
        assert sorted(out.columns) == names
        assert rows_of(names, [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]) == got
