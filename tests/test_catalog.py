"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from thicket.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SOME = ["match_first_child", "match_adjacent", "match_nested_two_captures", "multi_query_dedup", "search_stats", "html_links", "lang_dispatch", "excluded_dirs", "bloom_bits", "sieve_candidates", "index_status", "symbols_prefix_limit100", "symbols_exact_else_contains", "rewrite_apply", "rewrite_overlap", "code_symbols", "code_classes", "code_imports_go", "code_methods_rust", "symbols_build", "symbols_counts"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "part"):
        con.sql(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    theirs = duck.sql(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, theirs)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
