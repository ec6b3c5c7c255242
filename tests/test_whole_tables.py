"""Queries over whole tables and text files against their SQL."""

import duckdb
import pytest

from tidemill import catalogue

SF = "/root/testdata/sf0.001"
NAMES = (
    "gram_upper_mirrored", "gram_ragged_blocks", "gram_coo", "gram_rows", "matmul_ab", "matrix_transpose", "matrix_equal", "trace_extract", "metric_summary", "schedule_checks",
    "edge_list_text", "edge_list_weighted_text", "edge_list_text_degrees", "matrix_text_read", "pagerank_normalized_10_trade",
)


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "orders", "lineitem", "embeddings", "events"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect()))
    want = sorted(con.sql(catalogue.ORACLE_SQL[name]).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6) if isinstance(a[-1], float) else a == b


def test_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
