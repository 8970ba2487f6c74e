"""Every registered query of the reference's own operators against its SQL in another engine."""

import duckdb
import pytest

from prismatica import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) or hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_oracle(spark, sf, oracle, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = oracle.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want
