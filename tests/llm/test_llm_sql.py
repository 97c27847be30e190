"""The SQL of this subpackage against its queries."""

import duckdb
import pytest

from tidemark.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as from '{D}/{t}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, D).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
