"""Plain patterns over many text files at once: parse and match in one Arrow pass, nothing is shuffled.

A text's tree has three levels (document, line, word), and children of a node are
a range of the next level. So a pattern is bound level by level on arrays: a child
at the front, at the back or next to its elder sibling is found by its number, any
other by expanding ranges. Tests of texts look at each different text once. The
results are those of ``matcher.match`` for each file.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket import grammars
from thicket.operators import matcher
from thicket.operators.parse import spread
from thicket.plans.sexpr import Node, Pattern, Predicate
from thicket.schema import MATCHES

#: Files matched together.
FILES = 256
ROW = "file_path string, start_line int, start_col int, end_line int, end_col int, start_byte long, end_byte long, capture_name string, matched_text string"

_KINDS, _FIELDS = ("document", "line", "word"), (None, "line", "word")
#: Expressions that mean the same in RE2: no escapes of classes or word boundaries, no braces of properties.
_SAME_IN_RE2 = re.compile(r"(?:[^\\]|\\[^a-zA-Z0-9])*")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class _Level:
    """Nodes of one kind: bytes, parent, number among siblings and their number, range of children, and document."""

    def __init__(self, start, end, parent, number, siblings, first, children, doc, line) -> None:
        self.start, self.end, self.parent, self.number, self.siblings = start, end, parent, number, siblings
        self.first, self.children, self.doc, self.line = first, children, doc, line
        self.texts: pa.Array | None = None


class _Forest:
    """The trees of several valid texts."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.array([len(x) for x in texts], np.int64)
        self.base = np.r_[0, np.cumsum(size + 1)]
        self.data = b"\n".join([*texts, b""])
        buffer = np.frombuffer(self.data, np.uint8)
        line_end = np.flatnonzero(buffer == 10)
        line_start = np.r_[0, line_end[:-1] + 1]
        line_doc = np.searchsorted(self.base, line_start, "right") - 1
        first_line = np.searchsorted(line_start, self.base)
        edge = np.diff(np.r_[False, (buffer != 10) & (buffer != 32)].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        line = np.searchsorted(line_start, start, "right") - 1
        first_word = np.searchsorted(start, np.r_[line_start, len(buffer)])
        words, lines = np.diff(first_word), np.diff(first_line)
        self.line_start = line_start
        n, m = np.arange(len(texts)), np.arange(len(line_start))
        number = m - first_line[line_doc]
        zero = np.zeros(len(texts), np.int64)
        self.levels = [
            _Level(self.base[:-1], self.base[:-1] + size, zero, zero, zero + 1, first_line[:-1], lines, n, first_line[:-1]),
            _Level(line_start, line_end, line_doc, number, lines[line_doc], first_word[:-1], words, line_doc, m),
            _Level(start, end, line, np.arange(len(start)) - first_word[line], words[line], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), line_doc[line], line),
        ]
        self.first_line = first_line

    def text(self, level: int, at: np.ndarray) -> pa.Array:
        """Texts of nodes."""
        nodes = self.levels[level]
        if nodes.texts is None:
            # spans in order don't overlap within a level, so what lies between is every other entry
            offsets = np.stack([nodes.start, nodes.end], axis=1).ravel()
            offsets = np.r_[offsets, len(self.data)].astype(np.int64)
            nodes.texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data)])
        return nodes.texts.take(pa.array(2 * at))

    def place(self, at: np.ndarray, ends: bool, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line from 1, byte column and byte of the starts, or ends, of nodes."""
        nodes = self.levels[level]
        where, doc = (nodes.end if ends else nodes.start)[at], nodes.doc[at]
        line = nodes.line[at] if level or not ends else self.first_line[doc + 1] - 1
        return line - self.first_line[doc] + 1, where - self.line_start[line], where - self.base[doc]


def _passes(p: Predicate, texts: pa.Array, others: pa.Array | None) -> np.ndarray:
    if others is not None:
        found = pc.equal(texts, others).to_numpy(zero_copy_only=False)
        return ~found if p.name == "#not-eq?" else found
    if p.name in ("#eq?", "#not-eq?", "#any-of?"):
        found = pc.is_in(texts, value_set=pa.array(p.values, pa.large_string())).to_numpy(zero_copy_only=False)
        return ~found if p.name == "#not-eq?" else found
    found = None
    if _SAME_IN_RE2.fullmatch(p.values[0]):
        try:
            found = pc.match_substring_regex(texts, p.values[0]).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:
            found = None
    if found is None:
        coded = texts.dictionary_encode()
        each = np.array([matcher._search(p.values[0], x) for x in coded.dictionary.to_pylist()], bool)
        found = each[coded.indices.to_numpy()] if len(each) else np.zeros(0, bool)
    return ~found if p.name == "#not-match?" else found


def _flat(pattern: Pattern) -> list[tuple[Node, int | None, int | None, int]]:
    """Pattern nodes in order: node, number of its parent and of its elder sibling, depth."""
    out: list[tuple[Node, int | None, int | None, int]] = []

    def visit(n, parent, elder, depth):
        own, last = len(out), None
        out.append((n, parent, elder, depth))
        for c in n.children:
            last = visit(c, own, last, depth + 1)
        return own

    visit(pattern.root, None, None, 0)
    return out


def _bind(pattern: Pattern, flat, forest: _Forest, top: int) -> list[np.ndarray] | None:
    """For each pattern node the tree nodes of all bindings with the root at level ``top``."""
    owner = {c: i for i, (n, _, _, _) in enumerate(flat) for c in n.captures}
    bound: list[np.ndarray] = []
    for i, (n, parent, elder, depth) in enumerate(flat):
        level = top + depth
        if level > 2 or n.kind not in (None, _KINDS[level]) or n.named is False or n.field and n.field != _FIELDS[level]:
            return None
        nodes = forest.levels[level]
        if parent is None:
            at = np.arange(len(nodes.start))
            if n.first:
                at = at[nodes.number[at] == 0]
        else:
            above = forest.levels[level - 1]
            p = bound[parent]
            end = above.first[p] + above.children[p]
            if elder is not None and n.adjacent:
                at = bound[elder] + 1
                rows = np.flatnonzero(at < end)
                at = at[rows]
            elif n.first:
                rows = np.flatnonzero((above.children[p] > 0) & (elder is None))
                at = above.first[p[rows]]
            else:
                start = bound[elder] + 1 if elder is not None else above.first[p]
                if n.last:
                    start = np.maximum(start, end - 1)
                rows = np.repeat(np.arange(len(p)), np.maximum(end - start, 0))
                at = _ranges(start, np.maximum(end - start, 0))
            bound = [x[rows] for x in bound]
        keep = np.ones(len(at), bool)
        if n.last:
            keep &= nodes.number[at] == nodes.siblings[at] - 1
        if level < 2 and _FIELDS[level + 1] in n.absent:
            keep &= nodes.children[at] == 0
        for q in pattern.predicates:
            if q.other is None and owner[q.capture] == i:
                left = np.flatnonzero(keep)
                keep[left] = _passes(q, forest.text(level, at[left]), None)
        bound = [x[keep] for x in bound] + [at[keep]]
    for q in pattern.predicates:
        if q.other is not None:
            a, b = owner[q.capture], owner[q.other]
            keep = _passes(q, forest.text(top + flat[a][3], bound[a]), forest.text(top + flat[b][3], bound[b]))
            bound = [x[keep] for x in bound]
    return bound


def captures(patterns: list[Pattern], forest: _Forest) -> dict[tuple[int, str], np.ndarray]:
    """Captured nodes, each once, by level and capture name."""
    found: dict[tuple[int, str], list[np.ndarray]] = {}
    for pattern in patterns:
        flat = _flat(pattern)
        for top in range(3):
            bound = _bind(pattern, flat, forest, top)
            if bound is not None:
                for at, (n, _, _, depth) in zip(bound, flat, strict=True):
                    for name in n.captures:
                        found.setdefault((top + depth, name), []).append(at)
    out = {}
    for (level, name), parts in found.items():
        nodes = forest.levels[level]
        at = np.unique(np.concatenate(parts))
        out[level, name] = at[nodes.end[at] > nodes.start[at]]
    return out


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def match(files: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Match rows (schema.MATCHES) of plain patterns over text files with path and content; each row once a file."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, FILES):
                part = batch.slice(begin, FILES)
                contents = part.column(1).cast(pa.binary()).to_pylist()
                fine = [i for i, x in enumerate(contents) if x and _valid(x)]
                odd = set(range(len(contents))) - set(fine)
                if fine:
                    forest = _Forest([contents[i] for i in fine])
                    paths = part.column(0).take(pa.array(fine))
                    for (level, name), at in captures(patterns, forest).items():
                        if len(at):
                            l0, c0, s = forest.place(at, False, level)
                            l1, c1, e = forest.place(at, True, level)
                            small = [pa.array(x.astype(np.int32)) for x in (l0, c0, l1, c1)]
                            columns = [paths.take(pa.array(forest.levels[level].doc[at])), *small, pa.array(s), pa.array(e), pa.repeat(pa.scalar(name), len(at)), forest.text(level, at).cast(pa.string())]
                            yield pa.RecordBatch.from_arrays(columns, MATCHES)
                out = []
                for i in sorted(odd):
                    if contents[i]:
                        out += [(part.column(0)[i].as_py(), *row) for row in matcher.match(patterns, grammars.get("text").parse(contents[i]), contents[i])]
                if out:
                    kinds = (pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], MATCHES)

    return spread(files.filter(F.col("content").isNotNull()).select("path", "content")).mapInArrow(run, ROW)
