"""The queries of the corpus operators that have SQL equal DuckDB's answer."""

import duckdb
import pytest

from nitraflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SF).toArrow(), con.sql(queries.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names) and len(ours)
    names = sorted(ours.column_names)
    plain = lambda t: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in zip(*(t.column(c).to_pylist() for c in names), strict=True))
    assert plain(ours) == plain(theirs)
