"""The zone queries equal their SQL also where coordinates are halves of the digits that they are rounded to."""

import duckdb
import pytest
from test_oracle import rows

from nitraflow.plans import queries as library


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Embeddings on a grid of 0.005, so that every other one is a half of two digits; edges of zones lie between 0.14 and 0.15."""
    path = tmp_path_factory.mktemp("halves")
    at = "((i // 12 * {}) % (287 + 2 * (i % 12)) - 143 - i % 12) * 0.005"
    duckdb.sql(f"COPY (SELECT i AS vec_id, (i % 12)::INT AS label, [{at.format(89)}, {at.format(139)}]::FLOAT[] AS embedding FROM range(20000) r(i)) TO '{path}/embeddings.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["zonal_stats", "surplus_panel", "point_in_zone", "zones_from_text", "geojson_features"])
def test_halves_are_rounded_as_sql_does(spark, halves, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{halves}/embeddings.parquet'")
    ours, theirs = library.queries()[name](spark, halves).toArrow().to_pandas(), con.sql(library.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert len(ours) == len(theirs) and rows(ours) == rows(theirs)
