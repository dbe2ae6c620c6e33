"""Every query of the catalogue against its SQL twin, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from skein.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(found, columns):
    out = [tuple(None if (v := r[c]) is None else round(v, 9) if isinstance(v, float) and math.isfinite(v) else str(v) for c in columns) for r in found]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = db.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = rows([dict(zip(names, r, strict=True)) for r in found.fetchall()], columns)
    assert [tuple(map(str, r)) for r in rows(df.collect(), columns)] == [tuple(map(str, r)) for r in expected]


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
