"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_listed():
    missing = set(E.queries()) - set(E.oracle_sql())
    # the training-data queries state their own exceptions, beside their own tests
    assert {m for m in missing if not re.match(r"op\d+_|pipeline$", m)} == set()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, sdf.collect()) == _rows(dcols, res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["symbol", "date", "close", "volume", "rvol_20", "adr_20", "sma_50", "sma_200"]
    df.collect()
