"""Registered queries against their SQL on small odd tables."""

import re

import duckdb
import pytest

from thicket.plans import catalog


def same(spark, folder, name, **tables):
    """The query's rows, which must be those of its SQL."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    theirs = con.sql(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, theirs))
    return rows


def test_links_of_pages_with_one_url(spark, tmp_path):
    rows = [(1, "http://a/", '<a href="/x">x</a>'), (2, "http://a/", '<a href="/x">x</a><a href="/y">y</a>'), (3, None, '<a href="/z">z</a>'), (4, "http://b/", "<p>none</p>"), (5, "http://c/", None)]
    got = same(spark, tmp_path, "html_links", pages=("page_id long, url string, html string", rows))
    assert sorted(got) == [(1, "/x", 1), (2, "/x", 1), (2, "/y", 1), (3, "/z", 1)]


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_short_texts_are_renewed(spark, tmp_path):
    """Texts of fewer than three bytes have filters without bits; every kind of entry with each of them."""
    rows = [(i, text, "en", "s") for i, text in enumerate(["some text", "", "A.", None] * 27, 1)]
    got = same(spark, tmp_path, "index_refresh", documents=(DOCUMENTS, rows))
    # columns by name: file_size_bytes, mtime_secs, path, renewed
    assert {(size, renewed) for size, _, _, renewed in got} == {(size, renewed) for size in (9, 0, 2, None) for renewed in (False, True)}


def test_empty_files_are_skipped(spark, tmp_path):
    """Empty and missing texts among entries that are fresh, stale or not there."""
    rows = [(i, text, "en", "s") for i, text in enumerate(["an idiot text", "", "A.", None] * 27, 1)]
    got = same(spark, tmp_path, "search_counters", documents=(DOCUMENTS, rows))
    # columns by name: files_skipped, files_walked, files_with_matches, index_updates, matches
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(54, 108, 27, 27)]


PARTS = [(1, "large ring"), (2, "ringring"), (2, "ring"), (2, "ring"), (3, "äöü"), (4, "ab"), (5, ""), (6, None), (7, "aaaaaaa"), (None, "ring"), (None, "ring"), (8, "abc"), (8, None)]


@pytest.mark.parametrize("name", ["trigram_counts", "trigrams_part"])
def test_trigrams_of_odd_parts(spark, tmp_path, name):
    """Keys that are repeated or missing, names that are short, missing or not ASCII; nothing is grouped by part and trigram, which one task did for all parts."""
    assert same(spark, tmp_path, name, part=("p_partkey long, p_name string", PARTS))
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Aggregate\(keys=\[(.*?)\]", plan)
    assert keys and not any("," in k for k in keys)
