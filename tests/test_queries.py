"""Every registered query that has SQL against that SQL in another engine."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list | tuple) else str(v)


def test_each_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    told = duck.execute(ORACLE[name])
    columns = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted(str([plain(r[i]) for i in order]) for r in told.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns
