"""The matcher of whole text batches against the per-file matcher, and a search with an index against one without."""

import random

import pytest

from thicket import grammars
from thicket.operators import index, matcher, search, textmatch
from thicket.plans import sexpr
from thicket.sources import tables

QUERIES = [
    "(word) @w",
    "(line) @l",
    "(document) @d",
    "(_) @x",
    "(document (line (word) @w)) @d",
    "(document . (line) @first)",
    "(document (line) @last .)",
    "(line . (word) @a . (word) @b)",
    "(line (word) @a (word) @b)",
    "(line (word) @a . (word) @b .)",
    "(_ (_) @c (_) @d .)",
    "(document (line (word) @a) . (line (word) @b) (#eq? @a @b))",
    "(line (word) @a (word) @b (#not-eq? @a @b))",
    "(line !word) @l",
    "(document (line !word) @l)",
    "(line word: (word) @w (#any-of? @w \"a\" \"c\"))",
    '(word) @w (#match? @w "^[a-b]$")',
    '(word) @w (#match? @w "^\\\\w\\\\w$")',
    '(line) @l (#not-match? @l "b")',
    '(line (word) @w) @l (#eq? @w "a")',
    "(line . (word) @a (word) @b .)",
]


def test_same_as_per_file(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("aabc é  \n\n") for _ in range(draw.randrange(40))) for _ in range(60)] + ["", "\n", " ", "a", "a\n"]
    texts = [t.encode() for t in texts]
    grammar = grammars.get("text")
    for query in QUERIES:
        patterns = sexpr.parse(query)
        forest = textmatch._Forest(texts)
        got = {i: set() for i in range(len(texts))}
        for (level, name), at in textmatch.captures(patterns, forest).items():
            starts, ends = forest.place(at, False, level), forest.place(at, True, level)
            rows = zip(*(x.tolist() for x in (*starts[:2], *ends[:2], starts[2], ends[2])), forest.text(level, at).to_pylist(), forest.levels[level].doc[at].tolist(), strict=True)
            for *place, text, doc in rows:
                got[doc].add((*place, name, text))
        for i, text in enumerate(texts):
            assert sorted(got[i]) == matcher.match(patterns, grammar.parse(text), text), (query, text)


def test_frames(spark):
    rows = [(1, "a", "text", b"the cat"), (2, "b", "text", b"bad \xff byte"), (3, "c", "text", None), (4, "d", "text", b""), (5, "e", "rust", b"fn f() {}")]
    files = spark.createDataFrame([(*r, 0, 0) for r in rows], "file_id long, path string, language string, content binary, file_size_bytes long, mtime_secs long")
    got = search.search(files, ["(word) @w"], "text").collect()
    assert sorted((r["file_path"], r["matched_text"]) for r in got) == [("a", "cat"), ("a", "the"), ("b", "bad"), ("b", "byte")]


@pytest.fixture
def docs(spark):
    made = spark.createDataFrame([(i, f"w{i % 7} of {i} things" if i % 3 else "zebra here", "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    return tables.as_files(made, made.doc_id, made.doc_id.cast("string"), made.lang.substr(1, 0).isNull().cast("string"), made.text).withColumn("language", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("text"))


def test_indexed_search(spark, docs, tmp_path):
    queries = ['(word) @w (#eq? @w "zebra")']
    known = index.entries(docs.filter("file_id < 50"))
    plain, sieved = search.search(docs, queries, "text"), search.search(docs, queries, "text", index=known)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sieved.collect())) and plain.count() == 20
    row = search.counters(docs, sieved, known, queries, 2.0).first()
    assert row["files_walked"] == 60 and row["files_skipped"] == 0 and row["index_updates"] == 10
    assert row["files_rejected"] > 20 and row["files_parsed"] == 60 - row["files_rejected"]
    assert row["matches"] == row["files_with_matches"] == 20 and row["throughput"] == row["files_parsed"] / 2
    # a refreshed index goes where it was read from
    folder = str(tmp_path / "index")
    index.save(known, folder)
    index.save(index.refresh(index.load(spark, folder), docs), folder)
    assert index.load(spark, folder).count() == 60 and [p.name for p in tmp_path.iterdir()] == ["index"]
