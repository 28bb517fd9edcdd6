"""Every registered query against its DuckDB oracle on the smallest data
(the driver runs the same comparison at sf0.01; tools/check_oracle.py too)."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, family, rows_of

SF = "/root/testdata/sf0.001"
# The training-data operators, where installed, have tests of their own.
NAMES = sorted(n for n in entry.queries() if not re.fullmatch(r"op\d+_.*|pipeline", n))
SQL = {n: q for n, q in entry.oracle_sql().items() if n in NAMES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    srows = df.collect()
    rel = con.sql(SQL[name])
    a, ac = rows_of(df.columns, srows)
    b, bc = rows_of(rel.columns, rel.fetchall())
    assert ac == bc
    stypes = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {c: family(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert stypes == dtypes
    assert len(a) == len(b)
    assert a == b
