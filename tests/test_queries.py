"""Every query with an oracle, against it, on the smallest tables."""

import os

import duckdb
import pytest

from reachlight.plans import queries as Q

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def canon(df):
    return sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {n} as select * from '{D}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", list(Q.SQL))
def test_oracle(spark, con, name):
    got, want = Q.QUERIES[name](spark, D).toPandas(), con.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
