"""The symbol table: definitions found by patterns, kept by file, and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket import grammars
from thicket.operators import index, matcher
from thicket.operators.parse import spread
from thicket.plans import sexpr

# Symbol kinds.
KINDS = ["function", "method", "struct", "class", "interface", "enum", "trait", "typealias", "import", "constant", "variable", "module", "unknown"]
#: Most rows of a prefix lookup.
PREFIX_LIMIT = 100
SIGNATURE = 500
PREVIEW = 40

SCHEMA = "path string, kind string, name string, start_line int, start_col int, end_line int, end_col int, signature string"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def kind_of(text: Column) -> Column:
    """A known kind's name; ``type_alias`` is accepted; anything else is unknown."""
    given = F.lower(F.trim(text))
    return F.when(given == "type_alias", "typealias").when(given.isin(KINDS), given).otherwise("unknown")


def shortened(text: Column, length: int) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.char_length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length), F.lit("…")))


def extract(files: DataFrame) -> DataFrame:
    """Symbols of source files by their grammars' symbol patterns: one pass, nothing is shuffled."""
    compiled = {}
    for language in grammars.names():
        found = getattr(grammars.get(language), "symbols", None)
        if found:
            compiled[language] = [(kind, p) for kind, query in found for p in sexpr.parse(query)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, language, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not data or language not in compiled:
                    continue
                root, seen = grammars.get(language).parse(data), set()
                for kind, pattern in compiled[language]:
                    for binding in matcher.bindings(pattern, root, data):
                        row = _symbol(path, kind, dict(reversed(binding)), data)
                        if row and row not in seen:
                            seen.add(row)
                            out.append(row)
            if out:
                kinds = (*[pa.string()] * 3, *[pa.int32()] * 4, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["path", "kind", "name", "start_line", "start_col", "end_line", "end_col", "signature"])

    return spread(files.select("path", "language", "content")).mapInArrow(run, SCHEMA)


def _symbol(path, kind, captures, data):
    text = lambda n: data[n.start : n.end].decode("utf-8", "replace")
    first, last = captures.get("name"), captures.get("name")
    if "trait_name" in captures and "type_name" in captures:
        first, last = captures["trait_name"], captures["type_name"]
        name = f"{text(first)} for {text(last)}"
    elif first is not None:
        name = text(first)
    else:
        return None
    signature = text(captures["sig"]) if "sig" in captures else None
    if signature is not None and len(signature) > SIGNATURE:
        signature = signature[:SIGNATURE] + "…"
    return (path, kind, name, *matcher.place(data, first.start), *matcher.place(data, last.end), signature)


def upsert(symbols: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols after indexing ``files``: theirs are replaced by ``fresh``, others stay."""
    return symbols.join(files.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def drop_files(symbols: DataFrame, present: DataFrame) -> DataFrame:
    """Symbols without those of files that are gone."""
    return symbols.join(present.select("path").distinct(), "path", "left_semi")


def build(files: DataFrame, known: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and symbols after a walk: files that are new or changed are parsed again, fresh ones keep their symbols, those of files that are gone go.

    An unchanged file isn't parsed; one without definitions has an index entry and no symbols.
    """
    due = index.status(files, known).filter("status <> 'fresh'").select(*files.columns)
    return index.refresh(known, files), upsert(drop_files(symbols, files), extract(due), due)


def save(symbols: DataFrame, path: str) -> None:
    """Write the table beside what is there, and then put it in its place. ``symbols`` may have been read from there."""
    index.put_in_place(symbols, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def of_file(symbols: DataFrame, path: str) -> DataFrame:
    """One file's symbols in order of place."""
    return symbols.filter(F.col("path") == path).orderBy("start_line", "start_col", "kind", "name")


def counts(symbols: DataFrame) -> DataFrame:
    """How many files and symbols there are: one row."""
    return symbols.agg(F.countDistinct("path").alias("files"), F.count("*").alias("symbols"))


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def exact(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of that very name."""
    return symbols.filter(F.col("name") == name)


def prefix(symbols: DataFrame, start: str, limit: int | None = PREFIX_LIMIT) -> DataFrame:
    """The first symbols by name whose names start so, without regard to the case of A-Z; % and _ stand for any text and any character."""
    found = symbols.filter(_folded(F.col("name")).like(_like(start) + "%"))
    return found.orderBy("name", "path", "start_line", "start_col").limit(limit) if limit else found


def contains(symbols: DataFrame, part: str) -> DataFrame:
    return symbols.filter(_folded(F.col("name")).like("%" + _like(part) + "%"))


def _like(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")


def by_kind(symbols: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    found = symbols.filter(F.col("kind") == kind)
    return exact(found, name) if name is not None else found


def exact_else_contains(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of that name, or if there are none, those whose names hold it."""
    held = contains(symbols, name).withColumn("__exact", F.col("name") == name)
    some = held.agg(F.coalesce(F.max("__exact"), F.lit(False)).alias("__some"))
    return held.crossJoin(F.broadcast(some)).filter(F.col("__exact") | ~F.col("__some")).drop("__exact", "__some")


def lookup(symbols: DataFrame, files: DataFrame, symbol: str | None = None, start: str | None = None, kind: str | None = None, lang: str = "auto") -> DataFrame:
    """Symbols with their file's language, by exact name or by prefix."""
    if (symbol is None) == (start is None):
        raise ValueError("give exactly one of symbol and start")
    if not (symbol if symbol is not None else start).strip():
        raise ValueError("the name must not be blank")
    found = exact(symbols, symbol) if symbol is not None else prefix(symbols, start)
    if kind is not None:
        found = by_kind(found, kind)
    found = found.join(files.select("path", "language"), "path")
    return found if lang == "auto" else found.filter(F.col("language") == lang)


def orphans(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols whose file isn't known."""
    return symbols.join(files.select("path"), "path", "left_anti")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
