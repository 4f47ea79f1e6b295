"""Every trajectory query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from trajspark.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    found = con.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())
