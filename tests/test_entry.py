import duckdb
import pytest

import __spark_entry__ as entry
from marginalia.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rt_blocks", "lens_compose_two_hop", "coalesce_adjacent", "segment_boundaries", "facet_sql_update_delete"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {','.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, want))
