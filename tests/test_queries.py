"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from immunospark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(plain(r) for r in got.collect())
    if name not in SQL:
        assert rows
        return
    want = duck.execute('select ' + ', '.join(f'"{c}"' for c in got.columns) + f' from ({SQL[name]})').fetchall()
    assert rows == sorted(plain(r) for r in want)
