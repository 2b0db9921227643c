"""Every query with an SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from tidemark import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in columns] for r in df.collect()), key=repr)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(([norm(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == want
