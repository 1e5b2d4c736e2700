"""Every query of the library against its oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pairlake import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def canonical(frame, columns):
    def cell(v):
        if v is None or v != v:
            return None
        return v if isinstance(v, str) else round(float(v), 5)

    return sorted(repr([cell(v) for v in row]) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got, sorted(got.columns)) == canonical(want, sorted(got.columns))
    else:
        assert len(got)
