"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read from a path given by the caller and is opened on each
Python worker once; no network is used and nothing is trained. Long texts are
cut at *safe boundaries* before they reach the library, so that one call never
sees an unbounded string: a cut between a character that is no white space and
white space can't fall inside a match of the split pattern, because every
alternative of the pattern takes white space at its start only, and the
look-ahead in ``\\s+(?!\\S)`` looks right only. Pieces are therefore the same as
for the uncut text.

``LONG`` characters or more of white space, or of anything else without white
space between, don't reach the library, whose work would grow with their square
or whose stack would end. Of such white space all but the last character is one
piece if something follows, and all of it otherwise. Other stretches, with the
white space before them, are split by the pattern. Each piece is merged by a heap
of ranks and places, in the order in which the library merges.

Defined results: a null text counts as empty (no ids, empty bytes); repeated
rows and equal doc_ids are encoded row by row; other columns are untouched and
new names replace equally named input columns; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Longer texts (in characters) are cut at safe boundaries near this length.
CHUNK_CHARS = 1 << 16
#: Input rows handled between two output batches.
ROWS = 512

#: Characters of one kind that the library isn't given in one stretch.
LONG = 1 << 12

# Characters with the property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_STRETCH = re.compile(f"[^{_SPACE}]+")
_BLANKS = re.compile(f"[{_SPACE}]{{{LONG},}}")
_EITHER = re.compile(f"[{_SPACE}]{{{LONG},}}|[{_SPACE}]?[^{_SPACE}]{{{LONG},}}")


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a local file, whose lines are a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding for a local rank file (lines of base64 token and rank), without special tokens."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary at or after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def merged(piece: bytes, known: dict[bytes, int]) -> list[int]:
    """Ids of one piece: neighbours of the least rank are merged, the leftmost first, until no two are a token."""
    if piece in known:
        return [known[piece]]
    n = len(piece)
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # where the part after starts, and the one before
    alive = bytearray(b"\1") * n
    # a rank and a place in one integer; entries that no longer hold are passed over
    heap = [known[pair] * n + i for i in range(n - 1) if (pair := piece[i : i + 2]) in known]
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        j = after[i]
        if not alive[i] or j >= n or known.get(piece[i : after[j]]) != rank:
            continue
        end = after[i] = after[j]
        alive[j] = 0
        if end < n:
            before[end] = i
            found = known.get(piece[i : after[end]])
            if found is not None:
                heapq.heappush(heap, found * n + i)
        if i:
            h = before[i]
            found = known.get(piece[h:end])
            if found is not None:
                heapq.heappush(heap, found * n + h)
    ids, i = [], 0
    while i < n:
        ids.append(known[piece[i : after[i]]])
        i = after[i]
    return ids


def _has_long(text: str) -> bool:
    return len(text) >= LONG and (max(map(len, _STRETCH.findall(text)), default=0) >= LONG or _BLANKS.search(text) is not None)


def encode(text: str | None, path: str, pattern: str, size: int = CHUNK_CHARS) -> list[int]:
    """Ids of one text."""
    enc, ids, text, at = encoding(path, pattern), [], text or "", 0
    left = 0
    for found in _EITHER.finditer(text) if _has_long(text) else ():
        start, end = found.span()
        if start == at + left:  # white space that a long run has left for what follows
            start = at
        for chunk in safe_chunks(text[at:start], size):
            ids += enc.encode_ordinary(chunk)
        part = text[start:end]
        if _STRETCH.search(part):
            for piece in _splitter(pattern).findall(part):
                ids += merged(piece.encode(), ranks(path))
            left = 0
        else:
            left = int(end < len(text))
            end -= left
            ids += merged(text[start:end].encode(), ranks(path))
        at = end
    for chunk in safe_chunks(text[at:] if at else text, size):
        ids += enc.encode_ordinary(chunk)
    return ids


@functools.lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def decode(ids: Iterable[int], path: str, pattern: str) -> bytes:
    """Raw bytes of the ids; they need not be valid UTF-8."""
    return encoding(path, pattern).decode_bytes(list(ids))


def _batches(frame: DataFrame, schema: T.StructType, make) -> DataFrame:
    """mapInArrow over small slices: make(list of texts) returns the arrays of the new columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in frame.columns if c not in schema.fieldNames()]
    whole = T.StructType([*(frame.schema[c] for c in kept), *schema])

    def run(batches):
        target = to_arrow_schema(whole)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                new = make(part)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).cast(target.field(c).type) for c in kept), *new], schema=target)

    return frame.mapInArrow(run, whole)


def encode_texts(frame: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>) for every row's whole ``text``."""
    schema = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def make(part):
        return [pa.array([encode(x, path, pattern) for x in part.column(part.schema.get_field_index(text)).to_pylist()], pa.list_(pa.field("element", pa.int32(), False)))]

    return _batches(frame, schema, make)


def decode_ids(frame: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes that the ids stand for. Null ids count as none."""
    schema = T.StructType([T.StructField(out, T.BinaryType(), False)])

    def make(part):
        return [pa.array([decode(x or (), path, pattern) for x in part.column(part.schema.get_field_index(ids)).to_pylist()], pa.binary())]

    return _batches(frame, schema, make)


@functools.lru_cache(maxsize=4)
def _decimal(path: str, pattern: str) -> list[bytes]:
    return [b"%d" % i for i in range(encoding(path, pattern).n_vocab)]


def round_trip(frame: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: n_tokens, ids_sha256 (of ids in decimal, joined by commas), decoded_sha256, and with ``keep_ids`` the ids."""
    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] * keep_ids

    def make(part):
        spelled, counts, ids_sha, text_sha, kept = _decimal(path, pattern), [], [], [], []
        for x in part.column(part.schema.get_field_index(text)).to_pylist():
            got = encode(x, path, pattern)
            counts.append(len(got))
            ids_sha.append(hashlib.sha256(b",".join([spelled[i] for i in got])).hexdigest())
            text_sha.append(hashlib.sha256(decode(got, path, pattern)).hexdigest())
            if keep_ids:
                kept.append(array("i", got))
        new = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        if keep_ids:
            flat = np.concatenate([np.frombuffer(x, np.int32) for x in kept]) if kept else np.empty(0, np.int32)
            new.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat)).cast(pa.list_(pa.field("element", pa.int32(), False))))
        return new

    return _batches(frame, T.StructType(fields), make)
