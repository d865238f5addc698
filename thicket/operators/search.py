"""Structural search: queries over files, and what came of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket import grammars
from thicket.functions import sieve
from thicket.operators import index as file_index
from thicket.operators import matcher, textmatch
from thicket.operators.parse import parse_files, spread
from thicket.plans import compiler, sexpr
from thicket.schema import MATCHES, QueryCompileError


def compile_queries(queries: list[str], languages: list[str]) -> dict[str, list[sexpr.Pattern]]:
    """Patterns by language; languages for which no query compiles are left out, and if none is left the error is raised."""
    parsed, errors = [sexpr.parse(q) for q in queries], []
    out: dict[str, list[sexpr.Pattern]] = {}
    for language in languages:
        grammar = grammars.get(language)
        for patterns in parsed:
            try:
                for p in patterns:
                    compiler.check(p, grammar)
            except QueryCompileError as e:
                errors.append(f"{language}: {e}")
                continue
            out.setdefault(language, []).extend(patterns)
    if not out:
        raise QueryCompileError("; ".join(errors))
    return out


def match_joins(files: DataFrame, patterns: list[sexpr.Pattern]) -> DataFrame:
    """Matches of plain patterns by joins over the parsed nodes of ``files``; rows may repeat. ``search`` matches inside each file instead; over a stored node table, ``compiler.match`` is the way."""
    nodes = lambda *x: parse_files(files, *x)
    found = [compiler.match(p, nodes, with_path=True).drop("file_id") for p in patterns]
    return reduce(DataFrame.unionByName, found)


def match_files(files: DataFrame, compiled: dict[str, list[sexpr.Pattern]]) -> DataFrame:
    """Matches by the per-file matcher: parse and match in one pass, nothing is shuffled."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if content and language in compiled:
                    out += [(path, *row) for row in matcher.match(compiled[language], grammars.get(language).parse(content), content)]
            if out:
                kinds = (pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], MATCHES)

    return spread(files.filter(F.col("language").isin(sorted(compiled))).select("path", "language", "content")).mapInArrow(run, textmatch.ROW)


def search(files: DataFrame, queries: list[str], lang: str = "auto", index: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Match rows (schema.MATCHES), each once a file, of all queries over the files of one language or of all.

    A tree is local to its file, so files are parsed and matched in one pass and
    nothing is shuffled: plain patterns over text files on whole batches, all
    others file by file. With an ``index``, files whose fresh entry rules every
    query out aren't read into the parser. Order them with ``in_order`` where it
    matters.
    """
    compiled = compile_queries(queries, grammars.names() if lang == "auto" else [lang])
    if index is not None:
        files = file_index.candidates(files, index, queries, compat)
    parts = []
    if "text" in compiled and all(p.plain for p in compiled["text"]):
        parts.append(textmatch.match(files.filter("language = 'text'"), compiled.pop("text")))
    if compiled:
        parts.append(match_files(files, compiled))
    return reduce(DataFrame.unionByName, parts).select(*MATCHES)


def counters(files: DataFrame, matches: DataFrame, index: DataFrame | None = None, queries: list[str] | None = None, seconds: float | None = None) -> DataFrame:
    """One row of what a search went through: files walked, skipped (empty or unreadable), rejected by the index, parsed, index entries to renew, files with matches, matches, match_rate in per cent of parsed files, and throughput in parsed files a second (null without ``seconds``)."""
    seen = file_index.status(files, index) if index is not None else files.withColumn("status", F.lit("not_indexed")).withColumn("bits", F.lit(None).cast("array<int>"))
    skipped = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    rejected = (F.col("status") == "fresh") & ~sieve.accepts(F.col("bits"), queries) if index is not None and queries else F.lit(False)
    walked = seen.agg(
        F.count("*").alias("files_walked"),
        F.count_if(skipped & ~rejected).alias("files_skipped"),
        F.count_if(rejected).alias("files_rejected"),
        F.count_if(~skipped & ~rejected).alias("files_parsed"),
        F.count_if(~skipped & (F.col("status") != "fresh")).alias("index_updates"),
    )
    found = matches.agg(F.count("*").alias("matches"), F.countDistinct("file_path").alias("files_with_matches"))
    rate = F.when(F.col("files_parsed") == 0, F.lit(0.0)).otherwise(F.col("files_with_matches") * 100.0 / F.col("files_parsed"))
    speed = F.when(F.col("files_parsed") > 0, F.col("files_parsed") / F.lit(seconds).cast("double"))
    # one row each
    return walked.crossJoin(found).withColumn("match_rate", rate).withColumn("throughput", speed)


def in_order(matches: DataFrame) -> DataFrame:
    """By path components, then place, capture and text."""
    return matches.orderBy(F.split("file_path", "/"), *MATCHES[1:])


def stats(files: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: files, files with matches, matches, and the share of files with matches in per cent."""
    walked = files.agg(F.count("*").alias("files_parsed"))
    found = matches.agg(F.count("*").alias("matches"), F.countDistinct("file_path").alias("files_with_matches"))
    rate = F.when(F.col("files_parsed") == 0, F.lit(0.0)).otherwise(F.col("files_with_matches") * 100.0 / F.col("files_parsed"))
    return walked.crossJoin(found).select("files_parsed", "files_with_matches", "matches", rate.alias("match_rate"))


def matches_per_file(matches: DataFrame) -> DataFrame:
    return matches.groupBy("file_path").agg(F.count("*").alias("matches"))


def lines(matches: DataFrame) -> DataFrame:
    """Text lines as a search prints them."""
    return matches.select(F.format_string('%s:%d:%d  [@%s]  "%s"', "file_path", "start_line", "start_col", "capture_name", "matched_text").alias("line"))
