"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = "file_id long, path string, language string, content binary, file_size_bytes long, mtime_secs long"

#: A syntax-tree node. ``node_id`` is its pre-order number, so its descendants are
#: those from ``node_id + 1`` to ``last_desc_id``. ``named_idx`` counts named siblings
#: before it. Lines start at 1; columns and byte offsets at 0, ends are exclusive.
NODES = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sibling_idx", T.IntegerType()),
        T.StructField("named_idx", T.IntegerType()),
        T.StructField("last_desc_id", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("is_named", T.BooleanType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("has_children", T.BooleanType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("is_last_named", T.BooleanType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("start_col", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("end_col", T.IntegerType()),
        T.StructField("start_byte", T.LongType()),
        T.StructField("end_byte", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

MATCHES = ["file_path", "start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte", "capture_name", "matched_text"]


class EngineError(ValueError):
    """Any error of a search."""


class QueryCompileError(EngineError):
    """The pattern can't be compiled for any language asked for."""


class LanguageNotSupported(EngineError):
    """No grammar has that name."""


class IndexVersionMismatch(EngineError):
    """A stored index was written by another version."""
