"""Every registered query against its DuckDB oracle on the smallest input."""

import decimal

import duckdb
import pytest

from spanforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


def rows(table, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in table)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    columns = sorted(df.columns)
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    assert rows(df.collect(), columns) == rows([dict(zip(names, r, strict=True)) for r in found.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
