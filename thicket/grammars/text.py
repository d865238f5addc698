"""Plain text: document > line > word. Lines end with a newline, words are parted by single blanks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from thicket.grammars import register
from thicket.grammars.tree import Tree


class TextGrammar:
    kinds = frozenset({"document", "line", "word"})
    anonymous: frozenset[str] = frozenset()
    fields = frozenset({"line", "word"})

    def parse(self, data: bytes) -> Tree:
        root, at = Tree("document", 0, len(data)), 0
        for raw in data.split(b"\n"):
            line, start = root.add(Tree("line", at, at + len(raw)), "line"), at
            for word in raw.split(b" "):
                if word:
                    line.add(Tree("word", start, start + len(word)), "word")
                start += len(word) + 1
            at += len(raw) + 1
        return root

    def batches(self, ids: np.ndarray, texts: list[bytes], kinds: set[str] | None, with_text: bool):
        """The nodes of many valid files at once, for each kind which file a node is of and makers of its columns: the same rows as ``parse`` gives."""
        if not texts:
            return
        size = np.array([len(x) for x in texts], np.int64)
        base = np.r_[0, np.cumsum(size + 1)]
        buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        line_end = np.flatnonzero(buffer == 10)
        line_start = np.r_[0, line_end[:-1] + 1]
        line_doc = np.searchsorted(base, line_start, "right") - 1
        first_line = np.searchsorted(line_start, base)  # of each document, and past the end
        edge = np.diff(np.r_[False, (buffer != 10) & (buffer != 32)].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        line = np.searchsorted(line_start, start, "right") - 1
        first_word = np.searchsorted(start, np.r_[line_start, len(buffer)])  # of each line, and past the end
        doc_word = np.searchsorted(start, base)
        line_no = np.arange(len(line_start)) - first_line[line_doc]
        line_id = 1 + line_no + first_word[:-1] - doc_word[line_doc]
        word_doc = line_doc[line]
        in_line = np.arange(len(start)) - first_word[line]
        words = np.diff(first_word)

        def batch(kind, doc, number, parent, depth, sibling, siblings, last_desc, has, field, s, e, l0, c0, l1, c1, body):
            n = len(number)
            small = lambda x: pa.array(x.astype(np.int32))
            const = lambda v, t: pa.repeat(pa.scalar(v, t), n)
            last = lambda: pa.array(sibling == siblings - 1)

            def text():
                offsets = np.r_[0, np.cumsum(e - s)]
                return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(body().tobytes())]).cast(pa.string())

            return doc, {
                "file_id": lambda: pa.array(ids[doc]),
                "node_id": lambda: small(number),
                "parent_id": lambda: pa.nulls(n, pa.int32()) if parent is None else small(parent),
                "depth": lambda: const(depth, pa.int32()),
                "sibling_idx": lambda: small(sibling),
                "named_idx": lambda: small(sibling),
                "last_desc_id": lambda: small(last_desc),
                "kind": lambda: const(kind, pa.string()),
                "is_named": lambda: const(True, pa.bool_()),
                "is_error": lambda: const(False, pa.bool_()),
                "has_children": lambda: pa.array(has),
                "is_last": last,
                "is_last_named": last,
                "field_name": lambda: const(field, pa.string()),
                "start_line": lambda: small(l0),
                "start_col": lambda: small(c0),
                "end_line": lambda: small(l1),
                "end_col": lambda: small(c1),
                "start_byte": lambda: pa.array(s - base[doc]),
                "end_byte": lambda: pa.array(e - base[doc]),
                "text": lambda: text() if with_text else pa.nulls(n, pa.string()),
            }

        if kinds is None or "document" in kinds:
            doc = np.arange(len(texts))
            total = np.diff(first_line) + np.diff(doc_word)
            final = first_line[1:] - 1
            zero = np.zeros(len(doc), np.int64)
            yield batch("document", doc, zero, None, 0, zero, zero + 1, total, np.ones(len(doc), bool), None, base[:-1], base[:-1] + size, zero + 1, zero, line_no[final] + 1, line_end[final] - line_start[final], lambda: np.frombuffer(b"".join(texts), np.uint8))
        if kinds is None or "line" in kinds:
            yield batch("line", line_doc, line_id, np.zeros(len(line_id)), 1, line_no, np.diff(first_line)[line_doc], line_id + words, words > 0, "line", line_start, line_end, line_no + 1, np.zeros(len(line_id)), line_no + 1, line_end - line_start, lambda: buffer[buffer != 10])
        if (kinds is None or "word" in kinds) and len(start):
            number = line_id[line] + 1 + in_line
            yield batch("word", word_doc, number, line_id[line], 2, in_line, words[line], number, np.zeros(len(number), bool), "word", start, end, line_no[line] + 1, start - line_start[line], line_no[line] + 1, end - line_start[line], lambda: buffer[(buffer != 10) & (buffer != 32)])


register("text", TextGrammar())
