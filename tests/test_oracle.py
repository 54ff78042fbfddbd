"""Every query of the library that has SQL equals DuckDB's answer."""

import math

import duckdb
import pandas as pd
import pytest

from nitraflow.plans import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(p: pd.DataFrame) -> list[tuple]:
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(map(plain, r)) for r in p[sorted(p.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_equals_sql(spark, duck, name):
    ours, theirs = library.queries()[name](spark, SF).toArrow().to_pandas(), duck.sql(library.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_the_others_run(spark, name):
    assert library.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
