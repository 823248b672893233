"""Every query of the catalogue against its SQL in DuckDB, on the small tables."""

import duckdb
import pytest

from bitloom.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == rows
