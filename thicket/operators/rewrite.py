"""Rewriting: a template's edits of matched places, applied to whole files."""

from __future__ import annotations

import difflib
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"@([A-Za-z0-9_]+)")


def fill(template: str, captures: dict[str, str]) -> str:
    """The template with each @name of a capture replaced; longest names first, unknown ones stay."""
    names = sorted({n for n in _TOKEN.findall(template) if n in captures}, key=lambda n: (-len(n), n))
    for n in names:
        template = template.replace("@" + n, captures[n])
    return template


def filled(template: str, name: Column, text: Column) -> Column:
    """``fill`` with a row's own capture."""
    tokens = sorted(set(_TOKEN.findall(template)), key=lambda n: (-len(n), n))
    out = F.lit(template)
    for token in tokens:
        out = F.when(name == token, F.replace(F.lit(template), F.lit("@" + token), text)).otherwise(out)
    return out


def edits(matches: DataFrame, template: str) -> DataFrame:
    """(file_path, start_byte, end_byte, new_text) of captures that the template changes."""
    if not template:
        raise ValueError("the template must not be empty")
    named = F.regexp_replace("capture_name", r"\[.*$", "")
    return matches.withColumn("new_text", filled(template, named, F.col("matched_text"))).filter(F.col("new_text") != F.col("matched_text")).select("file_path", "start_byte", "end_byte", "new_text")


def overlaps(changes: DataFrame) -> DataFrame:
    """Edits that end after the next one of their file starts; equal ranges overlap, adjacent ones don't."""
    order = Window.partitionBy("file_path").orderBy("start_byte", "end_byte", "new_text")
    return changes.withColumn("next_start", F.lead("start_byte").over(order)).filter(F.col("end_byte") > F.col("next_start"))


def apply(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_path, content, rewritten, edits, error): each edited file; one file's error leaves the others alone."""
    grouped = changes.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "new_text"))).alias("changes"))
    joined = files.select(F.col("path").alias("file_path"), "content").join(grouped, "file_path")

    def run(batches):
        for batch in batches:
            done, errors = [], []
            for data, todo in zip(batch.column("content").to_pylist(), batch.column("changes").to_pylist(), strict=True):
                new, error = rewrite(data, [(e["start_byte"], e["end_byte"], e["new_text"]) for e in todo])
                done.append(new)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("content"), pa.array(done, pa.binary()), pa.array([len(x) for x in batch.column("changes").to_pylist()], pa.int64()), pa.array(errors, pa.string())], ["file_path", "content", "rewritten", "edits", "error"])

    return joined.select("file_path", "content", "changes").mapInArrow(run, "file_path string, content binary, rewritten binary, edits long, error string")


def rewrite(data: bytes, changes: list[tuple[int, int, str]]) -> tuple[bytes | None, str | None]:
    """The bytes with sorted changes applied, or why that isn't possible."""
    for (_, end, _), (start, _, _) in zip(changes, changes[1:], strict=False):
        if end > start:
            return None, f"overlapping edits at byte {start}"
    for start, end, new in reversed(changes):
        if not 0 <= start <= end <= len(data):
            return None, f"edit {start}..{end} is out of range"
        data = data[:start] + new.encode() + data[end:]
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return None, f"not UTF-8 after the edits: {e.reason}"
    return data, None


def diff(path: str, old: bytes, new: bytes) -> str:
    """A unified diff with three lines around changes; empty if nothing changed."""
    if old == new:
        return ""
    a, b = (x.decode("utf-8", "replace").splitlines(keepends=True) for x in (old, new))
    out = []
    for line in difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", n=3):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def with_diffs(applied: DataFrame) -> DataFrame:
    """Add the unified diff of each rewritten file."""
    make = F.udf(lambda p, o, n: None if n is None else diff(p, bytes(o), bytes(n)), "string")
    return applied.withColumn("diff", make("file_path", "content", "rewritten"))


def write_back(applied: DataFrame, root: str) -> None:
    """Replace files below ``root`` by their rewritten content, each by way of a file of its own beside it."""

    def put(rows):
        for r in rows:
            path = os.path.join(root, r["file_path"])
            beside = f"{path}.{os.getpid()}.tmp"
            with open(beside, "wb") as f:
                f.write(r["rewritten"])
            os.replace(beside, path)

    applied.filter("error is null").select("file_path", "rewritten").foreachPartition(put)
