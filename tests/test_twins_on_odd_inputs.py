"""Queries against their SQL twins on inputs that the test tables lack."""

import duckdb
import pytest

from tests.test_oracles import norm
from tidemark import registry

registry.load()


@pytest.fixture
def same(spark, tmp_path):
    def check(name, **tables):
        """``tables`` are SQL; both sides read the files that they fill."""
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        rows = sorted((tuple(norm(v) for v in r) for r in want.fetchall()), key=repr)
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr) == rows
        return rows

    return check


def test_confidence_of_odd_and_missing_texts(same):
    rows = same("text_confidence", documents="SELECT * FROM (VALUES (1, '?!?!'), (2, NULL), (3, ''), (4, 'a'), (5, '%%-- 0.5 !!??'), (6, 'Year 3')) AS t(doc_id, text)")
    assert dict(rows) == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.3, 5: 0.85, 6: 0.85}


def test_warnings_of_dense_curves(same):
    """Curves of 6,000 and of 12,000 points, which the twin counts under fallback calibration alone."""
    at = "TIMESTAMP '2024-01-01' + to_seconds(i * 100) AS ts"
    rows = same(
        "top_warnings",
        events=f"SELECT i AS event_id, {at}, (i % 3 // 2)::BIGINT AS user_id, 'view' AS event_type, (i % 500)::DOUBLE AS value FROM range(18000) r(i)",
    )
    assert rows == [("fallback calibration", 2)]
