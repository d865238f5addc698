"""Scan, search, sieve, index, symbols, rewriting, streaming and the line protocol."""

import json
import os

import pytest

from thicket.functions import sieve, trigram
from thicket.operators import index, matcher, parse, rewrite, search, symbols
from thicket.plans import rpc, sexpr
from thicket.schema import QueryCompileError
from thicket.sources import scan
from thicket.streaming import ingest


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in {
        "src/a.rs": b"fn alpha() {}\nfn beta() {}\n",
        "src/.hidden.RS": b"struct Hidden { x: i32 }\n",
        "src/b.py": b"def gamma():\n    pass\n",
        "target/x.rs": b"fn no() {}\n",
        "a/target.rs": b"fn kept() {}\n",
        "bin.rs": b"fn\0",
        "bad.rs": b"\xff\xfe",
        "empty.rs": b"",
        "skip/c.rs": b"fn ignored() {}\n",
        "skip2/d.rs": b"fn wanted() {}\n",
        "notes.txt": b"fn text",
        ".ignore": b"skip/\nskip2/*\n!skip2/d.rs\n",
    }.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_bytes(body)
    return str(root)


def test_scan_and_search(spark, tree):
    files = scan.scan(spark, tree).cache()
    errors = {r["path"]: r["error"] for r in files.collect()}
    assert set(errors) == {"src/a.rs", "src/.hidden.RS", "src/b.py", "a/target.rs", "bin.rs", "bad.rs", "empty.rs", "skip2/d.rs"}
    assert errors["bin.rs"] == errors["bad.rs"] == "binary file" and errors["empty.rs"] == "File is empty" and errors["src/a.rs"] is None
    good = files.filter("error is null")
    found = search.in_order(search.search(good, ["(function_item name: (identifier) @f)"])).collect()
    assert [(r["file_path"], r["matched_text"], r["start_line"]) for r in found] == [("a/target.rs", "kept", 1), ("skip2/d.rs", "wanted", 1), ("src/a.rs", "alpha", 1), ("src/a.rs", "beta", 2)]
    with pytest.raises(QueryCompileError):
        search.search(good, ["(no_such_kind) @x"])
    assert search.search(good, ["(struct_item)"]).count() == 0  # without a capture nothing is shown
    table = symbols.extract(good)
    assert {(r["kind"], r["name"]) for r in table.collect()} == {("function", x) for x in ("alpha", "beta", "gamma", "kept", "wanted")} | {("struct", "Hidden")}
    server = rpc.Server(good, table)
    assert json.loads(server.handle('{"jsonrpc":"2.0","id":1,"method":"lookup_symbol","params":{"name":"amm"}}'))["result"][0]["name"] == "gamma"
    codes = [json.loads(server.handle(x))["error"]["code"] for x in ("{", '{"id":1}', '{"jsonrpc":"2.0","method":"x"}', '{"jsonrpc":"2.0","method":"search_ast","params":{"query":" "}}', '{"jsonrpc":"2.0","method":"search_ast","params":{"query":"(nope) @x"}}')]
    assert codes == [-32700, -32600, -32601, -32602, -32603]


def test_joins_equal_the_matcher(spark):
    rows = [(1, "p/1", "text", bytearray("The a\nthe The b  x\n\nÄ the\n".encode())), (2, "p/2", "text", bytearray(b"")), (3, "p/3", "text", None), (4, "p/4", "text", bytearray(b"the\xff the b"))]
    files = spark.createDataFrame(rows, "file_id long, path string, language string, content binary")
    for q in ("(word) @w", "(line . (word) @a . (word) @b .)", '(line (word) @a (word) @b (#eq? @a @b))', "(line !word) @none", '(document (line (word) @w .) @l) @d', "(line (_) @x (#not-match? @x \"^[a-z]\"))"):
        plans = sexpr.parse(q)
        got = search.match_joins(files, plans).distinct()
        plain = search.match_files(files, {"text": plans})
        assert sorted(map(tuple, got.filter("file_path <> 'p/4'").select(plain.columns).collect())) == sorted(map(tuple, plain.filter("file_path <> 'p/4'").collect())), q
    nodes = parse.parse_files(files)
    assert nodes.filter("file_id = 3").count() == 0


def test_patterns():
    assert sexpr.unescape(r'"\d\\d\n"') == "d\\d\n"
    assert sexpr.java_regex("^a$|[$]") == "(?U)^a\\z|[$]"
    for bad in ("", "(", "(a", "(a))", '(#eq? @x "a")', '(a) @x (#eq? @y "a")', '(a) @x (#match? @x "(?=a)")', "(a) @x (#foo? @x)", "{"):
        with pytest.raises(QueryCompileError):
            sexpr.parse(bad)
    assert len(sexpr.parse("(a) @x ; note\n(b) @y")) == 2
    assert matcher._search("^init$", "init\n") is False


def test_trigrams_and_sieve(spark):
    assert [len(trigram.of_bytes(x.encode())) for x in ("", "a", "ab", "hello", "héllo")] == [0, 0, 0, 3, 4]
    assert trigram.bit_positions(trigram.of_bytes(b"abc")).tolist() == [[2315, 3178]]
    bits = trigram.bits_of(b"some text of a file")
    assert trigram.from_bitmap(trigram.bitmap(bits)) == bits
    files = spark.createDataFrame([(1, "x", "text", bytearray(b"has needle in it"), 16, 5), (2, "y", "text", bytearray(b"nothing"), 7, 5)], "file_id long, path string, language string, content binary, file_size_bytes long, mtime_secs long")
    known = index.entries(files)
    names = lambda queries, table=known, compat=False: sorted(r["path"] for r in index.candidates(files, table, queries, compat).collect())
    assert names(['(word) @w (#eq? @w "needle")']) == ["x"]
    assert names(['(word) @w (#match? @w "^need")']) == ["x", "y"] and names(['(word) @w (#match? @w "^need")'], compat=True) == []
    assert names(['(word) @w (#eq? @w "needle")', "(line) @l"]) == ["x", "y"]
    assert names(['(word) @w (#any-of? @w "needle" "nothing")']) == ["x", "y"]
    stale = known.withColumn("mtime_secs", known["mtime_secs"] + 1)
    assert names(['(word) @w (#eq? @w "needle")'], stale) == ["x", "y"]
    assert index.refresh(stale, files).count() == 2
    assert sieve.quoted('(a) (#eq? @x "b\\"c")') == ['b\\"c']


def test_rewrite(spark):
    assert rewrite.fill("@ab @a @zz @", {"a": "1", "ab": "2"}) == "2 1 @zz @"
    assert rewrite.rewrite(b"0123456789", [(0, 2, "x"), (2, 4, "yy")]) == (b"xyy456789", None)
    assert rewrite.rewrite(b"0123456789", [(2, 6, "x"), (5, 8, "y")])[1].startswith("overlapping")
    assert rewrite.rewrite(b"01", [(1, 9, "x")])[1].endswith("out of range")
    assert rewrite.diff("f", b"a\n", b"a\n") == "" and "-a" in rewrite.diff("f", b"a\n", b"b\n")
    with pytest.raises(ValueError):
        rewrite.edits(spark.range(1), "")


def test_streams(spark, tree, tmp_path):
    stream = ingest.search_stream(ingest.watch(spark, f"{tree}/src"), ["(function_item name: (identifier) @f)"], str(tmp_path / "out"), str(tmp_path / "state"))
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert sorted(r["matched_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["alpha", "beta"]
