"""The registered structural-search queries and their SQL counterparts.

Tables are seen as files: ``documents`` and ``conversations`` by the text grammar,
``pages`` by the HTML grammar. Every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import sieve, trigram
from thicket.operators import index, rewrite, search, symbols
from thicket.operators.parse import parse_files
from thicket.sources import scan, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLAGSHIP = '(document (line . (word) @first (#match? @first "^[A-Z]")))'


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' first words that start with a capital."""
    return search.search(tables.documents(spark, sf_dir), [FLAGSHIP], "text")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


#: Lines and words of documents with their byte places, as DuckDB finds them.
_TREE = r"""
WITH raw AS (
  SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, string_split(text, chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, path, unnest(parts) AS body, generate_subscripts(parts, 1) AS no FROM raw
), placed AS (
  SELECT *, octet_length(encode(body)) AS size,
         coalesce(sum(octet_length(encode(body)) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM line
), piece AS (
  SELECT doc_id, path, no, start, unnest(string_split(body, ' ')) AS body, generate_subscripts(string_split(body, ' '), 1) AS nr FROM placed
), spot AS (
  SELECT *, octet_length(encode(body)) AS size,
         coalesce(sum(octet_length(encode(body)) + 1) OVER (PARTITION BY doc_id, no ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col
  FROM piece
), word AS (
  SELECT doc_id, path, no, start + col AS start, col, size, body,
         row_number() OVER (PARTITION BY doc_id, no ORDER BY nr) AS idx,
         count(*) OVER (PARTITION BY doc_id, no) AS siblings,
         lead(body) OVER (PARTITION BY doc_id, no ORDER BY nr) AS after,
         lag(body) OVER (PARTITION BY doc_id, no ORDER BY nr) AS before
  FROM spot WHERE body <> ''
)
"""


def _words(capture: str, where: str = "true") -> str:
    return f"""SELECT path AS file_path, no::INTEGER AS start_line, col::INTEGER AS start_col, no::INTEGER AS end_line, (col + size)::INTEGER AS end_col,
  start::BIGINT AS start_byte, (start + size)::BIGINT AS end_byte, '{capture}' AS capture_name, body AS matched_text FROM word WHERE {where}"""


def _lines(capture: str, where: str = "true") -> str:
    return f"""SELECT path AS file_path, no::INTEGER AS start_line, 0 AS start_col, no::INTEGER AS end_line, size::INTEGER AS end_col,
  start::BIGINT AS start_byte, (start + size)::BIGINT AS end_byte, '{capture}' AS capture_name, body AS matched_text FROM placed WHERE body <> '' AND ({where})"""


def _pattern(name: str, queries: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(tables.documents(spark, sf_dir), queries, "text")

    run.__name__ = name
    query(_TREE + sql)(run)


_pattern("match_kind_word", ["(word) @w"], _words("w"))
_pattern("match_kind_line", ["(line) @l"], _lines("l"))
_pattern("match_first_child", [FLAGSHIP], _words("first", "idx = 1 AND regexp_matches(body, '^[A-Z]')"))
_pattern("match_last_child", ["(line (word) @last .)"], _words("last", "idx = siblings"))
_pattern("match_adjacent", ['(line (word) @a . (word) @b (#eq? @a "the"))'], _words("a", "body = 'the' AND after IS NOT NULL") + " UNION " + _words("b", "before = 'the'"))
_pattern("match_eq", ['(word) @w (#eq? @w "idiot")'], _words("w", "body = 'idiot'"))
_pattern("match_not_eq", ['(line . (word) @w (#not-eq? @w "The"))'], _words("w", "idx = 1 AND body <> 'The'"))
_pattern("match_any_of", ['(word) @w (#any-of? @w "de" "und" "la")'], _words("w", "body IN ('de', 'und', 'la')"))
_pattern("match_regex", ['(word) @w (#match? @w "^[a-z]+ing$")'], _words("w", "regexp_matches(body, '^[a-z]+ing$')"))
_pattern("match_field", ['(line word: (word) @w (#eq? @w "a"))'], _words("w", "body = 'a'"))
_pattern("match_two_predicates", ['(word) @w (#match? @w "^th") (#not-eq? @w "the")'], _words("w", "body LIKE 'th%' AND body <> 'the'"))
_pattern("match_wildcard", ['(line . (_) @first (#match? @first "\\\\.$"))'], _words("first", "idx = 1 AND body LIKE '%.'"))
_pattern("match_nested_two_captures", ['(line . (word) @w (#eq? @w "Is")) @l'], _words("w", "idx = 1 AND body = 'Is'") + " UNION " + _lines("l", "(doc_id, no) IN (SELECT (doc_id, no) FROM word WHERE idx = 1 AND body = 'Is')"))
_pattern("multi_query_dedup", ['(word) @w (#match? @w "^and")', '(word) @w (#any-of? @w "and" "or")'], _words("w", "body LIKE 'and%'") + " UNION " + _words("w", "body IN ('and', 'or')"))


@query(_TREE + "SELECT path AS file_path, count(*) AS matches, min(no)::INTEGER AS first_line FROM word WHERE body = 'the' GROUP BY path")
def matches_per_file(spark, sf_dir):
    """Matches and first matching line of each file."""
    found = search.search(tables.documents(spark, sf_dir), ['(word) @w (#eq? @w "the")'], "text")
    return found.groupBy("file_path").agg(F.count("*").alias("matches"), F.min("start_line").alias("first_line"))


@query(_TREE + ", hit AS (SELECT * FROM word WHERE body = 'idiot') SELECT (SELECT count(*) FROM documents) AS files_parsed, (SELECT count(DISTINCT path) FROM hit) AS files_with_matches, (SELECT count(*) FROM hit) AS matches, (SELECT count(DISTINCT path) FROM hit) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS match_rate")
def search_stats(spark, sf_dir):
    files = tables.documents(spark, sf_dir)
    return search.stats(files, search.search(files, ['(word) @w (#eq? @w "idiot")'], "text"))


@query(_TREE + "SELECT path || ':' || no || ':' || col || '  [@w]  \"' || body || '\"' AS line FROM word WHERE body = 'moron'")
def output_lines(spark, sf_dir):
    return search.lines(search.search(tables.documents(spark, sf_dir), ['(word) @w (#eq? @w "moron")'], "text"))


@query(_TREE + ", hit AS (SELECT DISTINCT path, no, col, body FROM word WHERE body = 'clown') SELECT path AS file_path, no::INTEGER AS start_line, col::INTEGER AS start_col, row_number() OVER (ORDER BY string_split(path, '/'), no, col) AS place FROM hit")
def sorted_component_order(spark, sf_dir):
    """The order by path components, as a column; few rows match."""
    found = search.search(tables.documents(spark, sf_dir), ['(word) @w (#eq? @w "clown")'], "text")
    ranked = F.row_number().over(Window.orderBy(F.split("file_path", "/"), "start_line", "start_col")).cast("long")
    return found.select("file_path", "start_line", "start_col", ranked.alias("place"))


@query(_TREE + "SELECT doc_id AS file_id, 'document' AS kind, 1::BIGINT AS nodes, 0 AS max_depth FROM raw UNION ALL SELECT doc_id, 'line', count(*), 1 FROM placed GROUP BY doc_id UNION ALL SELECT doc_id, 'word', count(*), 2 FROM word GROUP BY doc_id")
def node_counts(spark, sf_dir):
    """Nodes of each kind in each file."""
    nodes = parse_files(tables.documents(spark, sf_dir), with_text=False)
    return nodes.groupBy("file_id", "kind").agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))


@query(r"""WITH turns AS (SELECT conv_id, turn, role, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM conversations)
SELECT conv_id || '/' || turn || '.' || role AS file_path, count(*) AS matches FROM turns WHERE w = 'the' GROUP BY ALL""")
def conversation_words(spark, sf_dir):
    found = search.search(tables.conversations(spark, sf_dir), ['(word) @w (#eq? @w "the")'], "text")
    return search.matches_per_file(found)


@query(r"SELECT page_id AS file_id, x AS link, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS x FROM pages) WHERE x <> '' GROUP BY ALL")
def html_links(spark, sf_dir):
    """Targets of links by page."""
    # pages may share a url, so they go by their ids here
    files = tables.pages(spark, sf_dir).withColumn("path", F.col("file_id").cast("string"))
    found = search.search(files, ['(attribute (attribute_name) @n (quoted_attribute_value (attribute_value) @href) (#eq? @n "href"))'], "html")
    return found.filter("capture_name = 'href'").groupBy(F.col("file_path").cast("long").alias("file_id"), F.col("matched_text").alias("link")).agg(F.count("*").alias("links"))


@query(r"SELECT page_id AS file_id, lower(t) AS tag, count(*) AS tags FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|title|p|a|li)[\s>]', 1)) AS t FROM pages) GROUP BY ALL")
def html_tags(spark, sf_dir):
    nodes = parse_files(tables.pages(spark, sf_dir), {"tag_name"})
    opened = parse_files(tables.pages(spark, sf_dir), {"start_tag"}, with_text=False).select("file_id", F.col("node_id").alias("parent_id"))
    found = nodes.join(opened, ["file_id", "parent_id"]).withColumn("tag", F.lower("text")).filter(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6", "title", "p", "a", "li"))
    return found.groupBy("file_id", "tag").agg(F.count("*").alias("tags"))


_LANGUAGES = "CASE " + " ".join(f"WHEN e IN ({', '.join(repr(x) for x in xs)}) THEN '{k}'" for k, xs in scan.EXTENSIONS.items()) + " END"


@query(f"WITH p AS (SELECT doc_id, 'src/' || source || '/f' || doc_id || CASE doc_id % 9 WHEN 0 THEN '.rs' WHEN 1 THEN '.PY' WHEN 2 THEN '.tsx' WHEN 3 THEN '.h' WHEN 4 THEN '.cc' WHEN 5 THEN '.go' WHEN 6 THEN '.mjs' WHEN 7 THEN '.txt' ELSE '' END AS path FROM documents), x AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS e FROM p) SELECT doc_id, path, {_LANGUAGES} AS language FROM x")
def lang_dispatch(spark, sf_dir):
    """Languages of paths by extension."""
    ends = F.element_at(F.array(*map(F.lit, [".rs", ".PY", ".tsx", ".h", ".cc", ".go", ".mjs", ".txt", ""])), (F.col("doc_id") % 9 + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("src/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), ends)
    return docs.select("doc_id", path.alias("path")).withColumn("language", scan.language_of(F.col("path")))


_DIRS = ", ".join(repr(x) for x in scan.EXCLUDED)


@query(f"WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/target/x.rs' WHEN 1 THEN 'a/target.rs' WHEN 2 THEN '.git/' || page_id ELSE 'node_modules_x/y.js' END AS path FROM pages) SELECT page_id, path, len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda d: d IN ({_DIRS}))) > 0 AS excluded FROM p")
def excluded_dirs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.when(F.col("page_id") % 4 == 0, "a/target/x.rs").when(F.col("page_id") % 4 == 1, "a/target.rs").when(F.col("page_id") % 4 == 2, F.concat(F.lit(".git/"), F.col("page_id").cast("string"))).otherwise("node_modules_x/y.js")
    return pages.select("page_id", path.alias("path")).withColumn("excluded", scan.in_excluded(F.col("path")))


@query("SELECT doc_id, doc_id % 5 = 0 AS is_binary FROM documents")
def binary_sniff(spark, sf_dir):
    """Every fifth text gets a zero byte, or a byte that isn't UTF-8, in front; a character parted by the test's last byte makes a text binary, too, which the SQL doesn't know."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    front = F.when(F.col("doc_id") % 10 == 0, F.lit(bytearray(b"\0"))).when(F.col("doc_id") % 5 == 0, F.lit(bytearray(b"\xff"))).otherwise(F.lit(bytearray(b"")))
    content = F.concat(front, F.encode("text", "UTF-8"))
    return docs.select("doc_id", scan.is_binary(content).alias("is_binary"))


_GRAMS = """WITH g AS (SELECT p_partkey, upper(hex(encode(p_name))) AS h, octet_length(encode(p_name)) AS n FROM part),
grams AS (SELECT p_partkey, unnest(generate_series(0, n - 3)) AS i, h FROM g WHERE n >= 3), t AS (SELECT p_partkey, substr(h, (2 * i + 1)::BIGINT, 6) AS trigram FROM grams)"""


def _part_grams(spark, sf_dir):
    """All trigrams of each part in order of their bytes; each part is gathered in one place, so nothing is grouped by part and trigram."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").repartition("p_partkey").groupBy("p_partkey").agg(F.collect_list("p_name").alias("names"))
    return names.select("p_partkey", F.array_sort(F.flatten(F.transform("names", trigram.trigrams))).alias("grams"))


@query(_GRAMS + " SELECT trigram, count(*) AS uses, count(DISTINCT p_partkey) AS parts FROM t GROUP BY trigram")
def trigrams_part(spark, sf_dir):
    """Uses of each trigram, and the parts that hold it: its first use in each counts."""
    first = F.transform("grams", lambda g, i: F.struct(g.alias("trigram"), ((i == 0) | (F.get("grams", i - 1) != g)).alias("first")))
    uses = _part_grams(spark, sf_dir).select("p_partkey", F.inline(first))
    return uses.groupBy("trigram").agg(F.count("*").alias("uses"), F.count_if(F.col("first") & F.col("p_partkey").isNotNull()).alias("parts"))


@query(_GRAMS + " SELECT p_partkey, count(*) AS total, count(DISTINCT trigram) AS distinct_trigrams FROM t GROUP BY p_partkey")
def trigram_counts(spark, sf_dir):
    return _part_grams(spark, sf_dir).filter(F.size("grams") > 0).select("p_partkey", F.size("grams").cast("long").alias("total"), F.size(F.array_distinct("grams")).cast("long").alias("distinct_trigrams"))


def _fnv(seed: int) -> str:
    h = str(seed)
    for i in range(3):
        h = f"((xor({h}, ('0x' || substr(trigram, {2 * i + 1}, 2))::INTEGER) * {trigram.PRIME}) % {trigram.BITS})"
    return h


_BITS = _GRAMS + f", bits AS (SELECT DISTINCT p_partkey, b FROM (SELECT p_partkey, unnest([{_fnv(trigram.SEEDS[0])}, {_fnv(trigram.SEEDS[1])}]) AS b FROM t))"


def _part_bits(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return trigram.with_bits(parts.select("p_partkey", "p_name", F.col("p_name").cast("binary").alias("content")))


@query(_BITS + " SELECT p_partkey, string_agg(b::VARCHAR, ',' ORDER BY b) AS bits FROM bits GROUP BY p_partkey")
def bloom_bits(spark, sf_dir):
    return _part_bits(spark, sf_dir).select("p_partkey", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query(_BITS + " SELECT p_partkey, count(*)::INTEGER AS bit_count, pow(count(*) / 4096.0::DOUBLE, 2.0::DOUBLE) AS fpr FROM bits GROUP BY p_partkey")
def bloom_fpr(spark, sf_dir):
    return _part_bits(spark, sf_dir).select("p_partkey", F.size("bits").alias("bit_count"), trigram.false_positive_rate(F.col("bits")).alias("fpr"))


def _wanted(text: str) -> list[int]:
    return trigram.bits_of(text.encode())


@query(_BITS + f" SELECT p_partkey, count(*) FILTER (WHERE b IN ({', '.join(map(str, _wanted('metal')))})) = {len(_wanted('metal'))} AS candidate FROM bits GROUP BY p_partkey")
def sieve_candidates(spark, sf_dir):
    """Which names' filters allow for a query that requires a text."""
    return _part_bits(spark, sf_dir).select("p_partkey", sieve.accepts(F.col("bits"), ['(word) @w (#eq? @w "metal")']).alias("candidate"))


@query("SELECT 0::BIGINT AS lost, count(*) FILTER (WHERE contains(text, 'idiot')) AS holding FROM documents")
def sieve_no_false_negatives(spark, sf_dir):
    """No file that holds the text is rejected."""
    files = tables.documents(spark, sf_dir)
    seen = index.entries(files).select("path", sieve.accepts(F.col("bits"), ['(word) @w (#eq? @w "idiot")']).alias("ok"))
    both = files.select("path", F.contains(F.col("content").cast("string"), F.lit("idiot")).alias("holds")).join(seen, "path")
    return both.agg(F.count_if(F.col("holds") & ~F.col("ok")).alias("lost"), F.count_if("holds").alias("holding"))


def _walk(spark, sf_dir):
    """Documents as files with times, and what an earlier walk over them recorded; its filters hold a bit that no filter has, by which entries taken over are told from new ones."""
    files = tables.documents(spark, sf_dir).withColumn("mtime_secs", F.col("file_id") % 97)
    earlier = files.filter("file_id % 7 <> 3").select("path", (F.col("file_id") % 97 + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("mtime_secs"), "file_size_bytes", F.array(F.lit(-1)).alias("bits"), "language")
    return files, earlier


@query("SELECT source || '/' || doc_id || '.' || lang AS path, CASE WHEN doc_id % 7 = 3 THEN 'not_indexed' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'fresh' END AS status FROM documents")
def index_status(spark, sf_dir):
    return index.status(*_walk(spark, sf_dir)).select("path", "status")


@query("SELECT source || '/' || doc_id || '.' || lang AS path FROM documents WHERE doc_id % 7 = 3 OR doc_id % 5 = 0 OR contains(text, 'idiot')")
def index_candidates(spark, sf_dir):
    """Files that a search has to parse: not indexed, stale, or fresh with a filter that allows for the text. The filters' false positives are told by the texts here, so that SQL can say the same."""
    files, earlier = _walk(spark, sf_dir)
    earlier = earlier.drop("bits").join(index.entries(files).select("path", "bits"), "path")
    found = index.candidates(files, earlier, ['(word) @w (#eq? @w "idiot")'])
    fresh = index.status(found, earlier).filter("status = 'fresh'").filter(~F.contains(F.col("content").cast("string"), F.lit("idiot"))).select("path")
    return found.join(fresh, "path", "left_anti").select("path")


@query("SELECT source || '/' || doc_id || '.' || lang AS path, (doc_id % 97)::BIGINT AS mtime_secs, octet_length(encode(text))::BIGINT AS file_size_bytes, doc_id % 7 = 3 OR doc_id % 5 = 0 AS renewed FROM documents WHERE doc_id % 3 <> 0")
def index_refresh(spark, sf_dir):
    """The index after a walk in which every third file is gone."""
    files, earlier = _walk(spark, sf_dir)
    found = index.refresh(earlier, files.filter("file_id % 3 <> 0"))
    return found.select("path", "mtime_secs", "file_size_bytes", F.coalesce(~F.array_contains("bits", -1), F.lit(True)).alias("renewed"))


@query(_TREE + "SELECT path AS file_path, no::INTEGER AS start_line, col::INTEGER AS start_col, no::INTEGER AS end_line, (col + size)::INTEGER AS end_col, start::BIGINT AS start_byte, (start + size)::BIGINT AS end_byte, 'w' AS capture_name, body AS matched_text FROM word WHERE body = 'idiot'")
def indexed_search(spark, sf_dir):
    """A search that parses only files whose filters allow for the text."""
    files = tables.documents(spark, sf_dir)
    return search.search(files, ['(word) @w (#eq? @w "idiot")'], "text", index=index.entries(files))


@query(_TREE + ", hit AS (SELECT * FROM word WHERE body = 'idiot') SELECT (SELECT count(*) FROM documents) AS files_walked, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS files_skipped, (SELECT count(DISTINCT path) FROM hit) AS files_with_matches, (SELECT count(*) FROM hit) AS matches, (SELECT count(*) FROM documents WHERE text <> '' AND (doc_id % 7 = 3 OR doc_id % 5 = 0)) AS index_updates")
def search_counters(spark, sf_dir):
    """What a search went through; how many files the filters reject is not told, as it depends on false positives."""
    files, earlier = _walk(spark, sf_dir)
    queries = ['(word) @w (#eq? @w "idiot")']
    # a search makes no entries of empty files: it skips them
    earlier = earlier.drop("bits").join(index.entries(files.filter("file_size_bytes > 0")).select("path", "bits"), "path")
    found = search.counters(files, search.search(files, queries, "text", index=earlier), earlier, queries)
    return found.select("files_walked", "files_skipped", "files_with_matches", "matches", "index_updates")


_GAPS = ('(line (word) @a (word) @b (#eq? @a "la") (#eq? @b "de"))',)
_pattern("match_gap_siblings", list(_GAPS), _words("a", "body = 'la' AND EXISTS (FROM word x WHERE x.doc_id = word.doc_id AND x.no = word.no AND x.idx > word.idx AND x.body = 'de')") + " UNION " + _words("b", "body = 'de' AND EXISTS (FROM word x WHERE x.doc_id = word.doc_id AND x.no = word.no AND x.idx < word.idx AND x.body = 'la')"))


@query("SELECT source || '/' || doc_id || '.' || lang AS path FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 3 = 0")
def index_removed(spark, sf_dir):
    """Entries whose files are gone: every third is."""
    files, earlier = _walk(spark, sf_dir)
    return index.removed(earlier, files.filter("file_id % 3 <> 0")).select("path")


@query("SELECT source || '/' || doc_id || '.' || lang AS path FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 3 <> 0")
def index_kept(spark, sf_dir):
    files, earlier = _walk(spark, sf_dir)
    return index.kept(earlier, files.filter("file_id % 3 <> 0")).select("path")


_SYMBOLS = "WITH sym AS (SELECT 'part/' || (p_partkey % 50) || '.txt' AS path, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'class' ELSE 'import' END AS kind, p_name AS name, p_partkey::INTEGER AS start_line, 0 AS start_col FROM part)"


def _symbols(spark, sf_dir):
    """Part names as symbols of 50 files."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.element_at(F.array(*map(F.lit, ["function", "struct", "class", "import"])), F.col("p_size").cast("int") % 4 + 1)
    return parts.select(F.concat(F.lit("part/"), (F.col("p_partkey") % 50).cast("string"), F.lit(".txt")).alias("path"), kind.alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("start_line"), F.lit(0).alias("start_col"))


_SHOWN = " SELECT path, kind, name, start_line, start_col FROM "


@query(_SYMBOLS + _SHOWN + "sym WHERE name = (SELECT min(name) FROM sym)")
def symbols_exact(spark, sf_dir):
    found = _symbols(spark, sf_dir)
    return symbols.exact(found, found.agg(F.min("name")).first()[0] or "").select("path", "kind", "name", "start_line", "start_col")


@query(_SYMBOLS + _SHOWN + "sym WHERE kind = 'import' AND name = (SELECT max(name) FROM sym)")
def symbols_name_and_kind(spark, sf_dir):
    found = _symbols(spark, sf_dir)
    return symbols.by_kind(found, "import", found.agg(F.max("name")).first()[0] or "").select("path", "kind", "name", "start_line", "start_col")


@query(_SYMBOLS + _SHOWN + "sym WHERE name ILIKE 's%' ORDER BY name, path, start_line, start_col LIMIT 100")
def symbols_prefix_limit100(spark, sf_dir):
    return symbols.prefix(_symbols(spark, sf_dir), "S")


@query(_SYMBOLS + _SHOWN + "sym WHERE name ILIKE '%re_%'")
def symbols_contains(spark, sf_dir):
    return symbols.contains(_symbols(spark, sf_dir), "Re_")


@query(_SYMBOLS + _SHOWN + "sym WHERE kind = 'struct'")
def symbols_by_kind(spark, sf_dir):
    return symbols.by_kind(_symbols(spark, sf_dir), "struct")


@query(_SYMBOLS + _SHOWN + "sym WHERE CASE WHEN (SELECT count(*) FROM sym WHERE name = 'e') > 0 THEN name = 'e' ELSE name ILIKE '%e%' END")
def symbols_exact_else_contains(spark, sf_dir):
    return symbols.exact_else_contains(_symbols(spark, sf_dir), "e")


@query(_SYMBOLS + " SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY start_line, start_col) AS place FROM sym")
def symbols_file_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("path").orderBy("start_line", "start_col")).cast("long")
    return _symbols(spark, sf_dir).select("path", "name", place.alias("place"))


@query(_SYMBOLS + " SELECT s.path, name, kind, start_line, CASE WHEN split_part(replace(s.path, '.txt', ''), '/', 2)::INTEGER % 2 = 0 THEN 'rust' ELSE 'go' END AS language FROM sym s WHERE kind = 'class' AND split_part(replace(s.path, '.txt', ''), '/', 2)::INTEGER % 2 = 0 AND name ILIKE 's%' AND (name, s.path, start_line) IN (SELECT (name, path, start_line) FROM sym WHERE name ILIKE 's%' ORDER BY name, path, start_line, start_col LIMIT 100)")
def lookup_join_file(spark, sf_dir):
    """A prefix lookup, whose limit comes before the filters of kind and language."""
    found = _symbols(spark, sf_dir)
    files = found.select("path").distinct().withColumn("language", F.when(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 2 == 0, "rust").otherwise("go"))
    return symbols.lookup(found, files, start="s", kind="class", lang="rust").select("path", "name", "kind", "start_line", "language")


@query(_SYMBOLS + " SELECT path, name FROM sym WHERE split_part(replace(path, '.txt', ''), '/', 2)::INTEGER % 3 = 0")
def symbols_orphans(spark, sf_dir):
    found = _symbols(spark, sf_dir)
    known = found.select("path").distinct().filter(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 3 != 0)
    return symbols.orphans(found, known).select("path", "name")


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || '…' END AS signature FROM documents")
def signature_truncate(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", symbols.shortened(F.col("text"), symbols.SIGNATURE).alias("signature"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 40) || '…' END AS preview FROM documents")
def text_preview(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", symbols.shortened(F.col("text"), symbols.PREVIEW).alias("preview"))


_HITS = '(word) @w (#match? @w "^th[a-z]*ing$")'


@query(_TREE + "SELECT path AS file_path, start::BIGINT AS start_byte, (start + size)::BIGINT AS end_byte, '<' || body || '>' AS new_text FROM word WHERE regexp_matches(body, '^th[a-z]*ing$')")
def rewrite_edits(spark, sf_dir):
    return rewrite.edits(search.search(tables.documents(spark, sf_dir), [_HITS], "text"), "<@w>")


@query(r"""WITH l AS (SELECT source || '/' || doc_id || '.' || lang AS file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
w AS (SELECT file_path, no, unnest(string_split(line, ' ')) AS body, generate_subscripts(string_split(line, ' '), 1) AS nr FROM l),
hit AS (SELECT *, regexp_matches(body, '^th[a-z]*ing$') AS yes FROM w),
j AS (SELECT file_path, no, string_agg(CASE WHEN yes THEN '<' || body || '>' ELSE body END, ' ' ORDER BY nr) AS line, count(*) FILTER (WHERE yes) AS n FROM hit GROUP BY file_path, no)
SELECT file_path, md5(string_agg(line, chr(10) ORDER BY no)) AS rewritten_md5, sum(n)::BIGINT AS edits FROM j GROUP BY file_path HAVING sum(n) > 0""")
def rewrite_apply(spark, sf_dir):
    files = tables.documents(spark, sf_dir)
    done = rewrite.apply(files, rewrite.edits(search.search(files, [_HITS], "text"), "<@w>"))
    return done.filter("error is null").select("file_path", F.md5("rewritten").alias("rewritten_md5"), "edits")


@query(_TREE + "SELECT l.path AS file_path, l.start::BIGINT AS start_byte, (l.start + l.size)::BIGINT AS end_byte FROM placed l WHERE (l.doc_id, l.no) IN (SELECT (doc_id, no) FROM word WHERE idx = 1 AND body = 'Is')")
def rewrite_overlap(spark, sf_dir):
    """Lines whose edit overlaps that of their first word."""
    found = search.search(tables.documents(spark, sf_dir), ['(line . (word) @w (#eq? @w "Is")) @l'], "text")
    changes = found.select("file_path", "start_byte", "end_byte", F.lit("x").alias("new_text"))
    # the shorter of two ranges with one start comes first, and ends after the longer one's start
    widest = changes.groupBy("file_path", "start_byte").agg(F.max("end_byte").alias("end_byte"))
    return rewrite.overlaps(changes).select("file_path", "start_byte").join(widest, ["file_path", "start_byte"]).select("file_path", "start_byte", "end_byte").distinct()


# Sources of every language; @@ stands for the document's id. Beside each, what is defined in it: kind, name, line, column, signature.
_SOURCES = [
    ("rust", "rs", "use std::io;\nstruct Point@@ { x: i32 }\nenum Mode@@ { A, B }\ntrait Shape@@ { }\nimpl Shape@@ for Point@@ { fn area(&self) -> i32 { 1 } }\ntype Id@@ = u64;\nfn run@@(n: i32) -> i32 { n }\n", [
        ("import", "std::io", 1, 4, "use std::io;"), ("struct", "Point@@", 2, 7, "struct Point@@ { x: i32 }"), ("enum", "Mode@@", 3, 5, "enum Mode@@ { A, B }"), ("trait", "Shape@@", 4, 6, "trait Shape@@ { }"),
        ("trait", "Shape@@ for Point@@", 5, 5, "impl Shape@@ for Point@@ { fn area(&self) -> i32 { 1 } }"), ("typealias", "Id@@", 6, 5, "type Id@@ = u64;"), ("function", "run@@", 7, 3, "fn run@@(n: i32) -> i32 { n }")]),
    ("python", "py", "import os.path\nfrom a.b import c\nclass A@@(B):\n    def m(self):\n        return 1\ndef f@@(x):\n    return x\n", [
        ("import", "os.path", 1, 7, "import os.path"), ("import", "a.b", 2, 5, "from a.b import c"), ("class", "A@@", 3, 6, "class A@@(B):\n    def m(self):\n        return 1"), ("function", "m", 4, 8, "def m(self):\n        return 1"), ("function", "f@@", 6, 4, "def f@@(x):\n    return x")]),
    ("js", "js", "import x from 'y';\nclass A@@ { }\nfunction f@@(n) { return n; }\n", [
        ("import", "'y'", 1, 14, "import x from 'y';"), ("class", "A@@", 2, 6, "class A@@ { }"), ("function", "f@@", 3, 9, "function f@@(n) { return n; }")]),
    ("ts", "ts", "interface I@@ { a: string }\ntype T@@ = string;\nclass C@@ { }\nenum E@@ { X }\nfunction f@@(): void { }\n", [
        ("interface", "I@@", 1, 10, "interface I@@ { a: string }"), ("typealias", "T@@", 2, 5, "type T@@ = string;"), ("class", "C@@", 3, 6, "class C@@ { }"), ("function", "f@@", 5, 9, "function f@@(): void { }")]),
    ("go", "go", "package main\nimport \"fmt\"\nimport (\n\t\"os\"\n)\ntype P@@ struct {\n\tX int\n}\nfunc (p P@@) area() int {\n\treturn 1\n}\nfunc run@@() {\n}\n", [
        ("import", '"fmt"', 2, 7, '"fmt"'), ("struct", "P@@", 6, 5, "P@@ struct {\n\tX int\n}"), ("function", "run@@", 12, 5, "func run@@() {\n}")]),
    ("c", "c", "struct P@@ { int x; };\nenum M@@ { A };\ntypedef struct { int y; } Q@@;\nint add@@(int a) { return a; }\n", [
        ("struct", "P@@", 1, 7, "struct P@@ { int x; }"), ("enum", "M@@", 2, 5, "enum M@@ { A }"), ("struct", "Q@@", 3, 26, "typedef struct { int y; } Q@@;"), ("function", "add@@", 4, 4, "add@@(int a)")]),
    ("cpp", "cpp", "class A@@ { };\nint add@@(int a) { return a; }\n", [
        ("class", "A@@", 1, 6, "class A@@ { }"), ("function", "add@@", 2, 4, "add@@(int a)")]),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _code(spark, sf_dir):
    """Each document's id as a source file of one of the languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").filter("doc_id is not null")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in _SOURCES)), F.pmod("doc_id", F.lit(len(_SOURCES))).cast("int") + 1)
    name = F.col("doc_id").cast("string")
    return tables.as_files(docs, F.col("doc_id"), F.concat(F.lit("code/"), name, F.lit("."), pick(1)), pick(0), F.replace(pick(2), F.lit("@@"), name))


def _code_rows(kinds: str) -> str:
    rows = [f"({i}, {_quoted(ext)}, {_quoted(kind)}, {_quoted(name)}, {line}, {col}, {_quoted(sig)})" for i, (_, ext, _, found) in enumerate(_SOURCES) for kind, name, line, col, sig in found if kind in kinds.split()]
    return f"""SELECT 'code/' || doc_id || '.' || ext AS path, kind, replace(name, '@@', doc_id::VARCHAR) AS name, line::INTEGER AS start_line, col::INTEGER AS start_col, replace(sig, '@@', doc_id::VARCHAR) AS signature
FROM documents JOIN (VALUES {', '.join(rows)}) v(slot, ext, kind, name, line, col, sig) ON doc_id % {len(_SOURCES)} = slot"""


@query(_code_rows(" ".join(symbols.KINDS)))
def code_symbols(spark, sf_dir):
    """Definitions of all kinds in sources of the seven languages."""
    return symbols.extract(_code(spark, sf_dir)).select("path", "kind", "name", "start_line", "start_col", "signature")


@query("SELECT path AS file_path, start_line, start_col, 'n' AS capture_name, name AS matched_text FROM (" + _code_rows("class") + ") WHERE path NOT LIKE '%.py' AND path NOT LIKE '%.js'")
def code_classes(spark, sf_dir):
    """Classes by their names' kind, in the languages where that query compiles."""
    found = search.search(_code(spark, sf_dir), ["(class_specifier name: (type_identifier) @n)", "(class_declaration name: (type_identifier) @n)"])
    return found.select("file_path", "start_line", "start_col", "capture_name", "matched_text")


@query("SELECT 'code/' || doc_id || '.go' AS file_path, line::INTEGER AS start_line, col::INTEGER AS start_col, path AS matched_text FROM documents, (VALUES (2, 7, '\"fmt\"'), (4, 1, '\"os\"')) v(line, col, path) WHERE doc_id % 7 = 4")
def code_imports_go(spark, sf_dir):
    """Imports by themselves and in a list."""
    found = search.search(_code(spark, sf_dir), ["(import_spec path: (interpreted_string_literal) @p)"], "go")
    return found.select("file_path", "start_line", "start_col", "matched_text")


@query("SELECT 'code/' || doc_id || '.rs' AS file_path, 'area' AS matched_text FROM documents WHERE doc_id % 7 = 0")
def code_methods_rust(spark, sf_dir):
    """Functions inside implementations only."""
    return search.search(_code(spark, sf_dir), ["(impl_item body: (declaration_list (function_item name: (identifier) @m)))"], "rust").select("file_path", "matched_text")


_BUILT = "doc_id % 7 <> 3 AND doc_id % 5 <> 0"


@query("SELECT path, kind, CASE WHEN " + _BUILT + " THEN 'old' ELSE name END AS name FROM (SELECT *, regexp_extract(path, '(\\d+)', 1)::BIGINT AS doc_id FROM (" + _code_rows(" ".join(symbols.KINDS)) + ")) WHERE doc_id % 3 <> 0")
def symbols_build(spark, sf_dir):
    """Symbols after a walk: a third of the files is gone, some are new or changed, and what fresh files had stays, here under the name old."""
    files = _code(spark, sf_dir).withColumn("mtime_secs", F.when(F.col("file_id") % 5 == 0, 1).otherwise(0).cast("long"))
    earlier = _code(spark, sf_dir).filter("file_id % 7 <> 3")
    before = symbols.extract(earlier).withColumn("name", F.lit("old"))
    _, after = symbols.build(files.filter("file_id % 3 <> 0"), index.entries(earlier), before)
    return after.select("path", "kind", "name")


@query("SELECT count(DISTINCT path) AS files, count(*) AS symbols FROM (" + _code_rows(" ".join(symbols.KINDS)) + ")")
def symbols_counts(spark, sf_dir):
    return symbols.counts(symbols.extract(_code(spark, sf_dir)))
