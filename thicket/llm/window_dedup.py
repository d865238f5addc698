"""Substring dedup on words: delete every word that lies in a window of ``size`` words which also starts earlier.

Method: difference-cover anchors. A set C of residues modulo p is a difference
cover if every difference of positions occurs between two members of C. Any two
equal windows at positions i and j then have an offset d < p for which i + d and
j + d are both cover positions. Only windows of size - p + 1 words at cover
positions (*anchors*) are hashed and exchanged; those that occur twice are shared
aligned anchors. Around them, and only there, whole windows are compared
(extension): their 128-bit hashes are exchanged with the owning document, and
the earliest owner keeps its words.

Stages (see ``blockwise``): blocks emit their distinct anchors, and one digest a
text; buckets answer which of them other blocks have too; blocks emit distinct
windows that hold a shared anchor; buckets answer which have an earlier owner;
blocks delete. Whole copies of an earlier text need no windows.

Defined results: null text: no words, empty rest. Order of documents: id, null
ids last, equal ids by text within a block and by block otherwise; equal rows
count as documents of their own, the first keeps its words. Texts too short for
``size`` words enter no block. Words are maximal
runs other than blanks U+0020 and U+0009 to U+000D, compared byte by byte. The
result has the columns below only, so clashing extra columns don't matter. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import blockwise as B
from thicket.llm import hashing as H

#: Perfect difference covers by period (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

ANCHOR, COPY, WINDOW = 0, 1, 2
#: Words on average, for the number of buckets.
_WORD_BYTES = 6

RESULT = "doc_id long, n_words long, n_removed long, kept string"


def period_for(size: int) -> int:
    """The largest known period that leaves anchors of at least a third of the window."""
    return max(p for p in COVERS if size - p + 1 >= max(1, size // 3))


class _Block:
    """The words of a block's documents, in order."""

    def __init__(self, table: pa.Table, size: int) -> None:
        self.size, self.period = size, period_for(size)
        self.texts = B.Texts(table)
        buffer, bounds = H.join_texts(self.texts.texts)
        starts, ends = H.word_spans(buffer)
        self.words, self.more = H.word_hashes(buffer, starts, ends)
        self.first = np.searchsorted(starts, bounds)
        self.doc = np.repeat(np.arange(len(self.texts.texts)), np.diff(self.first))
        self.long = np.diff(self.first) >= size

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows at cover positions."""
        width = self.size - self.period + 1
        n = np.arange(max(0, len(self.words) - width + 1))
        doc = self.doc[: len(n)]
        at = np.zeros(self.period, bool)
        at[list(COVERS[self.period])] = True
        here = n[at[(n - self.first[doc]) % self.period] & (n + width <= self.first[doc + 1])]
        return here, H.windows(self.words, width)[here]

    def copies(self, replies: pa.Table) -> np.ndarray:
        """Which documents are later copies of a whole text."""
        known, _ = B.gathered(replies, COPY, B.PAIR)
        return (self.texts.again | B.pair_among(self.texts.a, self.texts.b, known)) & self.long

    def candidates(self, replies: pa.Table, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows with a shared anchor outside whole copies, and their hashes."""
        at, hashes = self.anchors()
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, H.U64), np.empty(0, H.U64)
        known, _ = B.gathered(replies, ANCHOR, B.HASH)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        shared = B.is_among(hashes, known)
        shared[order] |= np.r_[same, False] | np.r_[False, same]
        sums = np.zeros(len(self.words) + 1, np.int32)
        sums[at[shared] + 1] = 1
        sums = np.cumsum(sums, dtype=np.int32)
        n = np.arange(len(self.words) - self.size + 1) if len(self.words) >= self.size else np.empty(0, np.int64)
        doc = self.doc[: len(n)]
        here = n[(sums[n + self.period] > sums[n]) & (n + self.size <= self.first[doc + 1]) & ~copies[doc]]
        return here, H.windows(self.words, self.size)[here], H.windows(self.more, self.size, 1)[here]


def _emit_anchors(size: int, buckets: int):
    def run(key, table):
        block, number = _Block(table, size), key[0].as_py()
        hashes = np.unique(block.anchors()[1])
        once = np.flatnonzero(block.long & ~block.texts.again)
        records = block.texts.owned(once, block.texts.a[once], block.texts.b[once])
        return B.table_of([*B.deal(number, ANCHOR, hashes, hashes, buckets), *B.deal(number, COPY, records, records["hash"], buckets)])

    return run


def _answer(table):
    anchors, blocks = B.gathered(table, ANCHOR, B.HASH)
    twice = B.in_several_blocks(anchors, blocks)
    rows = [*B.answers(ANCHOR, anchors[twice], blocks[twice])]
    for kind in (COPY, WINDOW):
        records, blocks = B.gathered(table, kind, B.OWNED)
        late = B.owned_elsewhere(records, blocks)
        rows += B.answers(kind, B.pairs(records[late]), blocks[late])
    return B.table_of(rows)


def _emit_windows(size: int, buckets: int):
    def run(key, table, replies):
        if not table.num_rows:
            return B.table_of([])
        block = _Block(table, size)
        here, a, b = block.candidates(replies, block.copies(replies))
        once, _ = B.first_of_each(a, b)
        records = block.texts.owned(block.doc[here[once]], a[once], b[once])
        return B.table_of(B.deal(key[0].as_py(), WINDOW, records, records["hash"], buckets))

    return run


def _delete(size: int):
    def run(table, replies):
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        block = _Block(table, size)
        copies = block.copies(replies)
        here, a, b = block.candidates(replies, copies)
        _, is_first = B.first_of_each(a, b)
        late = ~is_first | B.pair_among(a, b, B.gathered(replies, WINDOW, B.PAIR)[0])
        step = np.zeros(len(block.words) + 1, np.int32)
        np.add.at(step, here[late], 1)
        np.add.at(step, here[late] + size, -1)
        gone = (np.cumsum(step[:-1]) > 0) | copies[block.doc]
        totals = np.r_[0, np.cumsum(gone)]
        n_words, removed = np.diff(block.first), totals[block.first[1:]] - totals[block.first[:-1]]
        kept = []
        for i, text in enumerate(block.texts.texts):
            words = text.split()
            if removed[i]:
                words = [w for w, g in zip(words, gone[block.first[i] : block.first[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
        return pa.table({"doc_id": block.texts.arrow_ids(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def dedupe(frame: DataFrame, size: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one blank, one row for each input row."""
    total = B.text_bytes(frame, text)
    long = F.coalesce(F.octet_length(text) >= 2 * size - 1, F.lit(False))
    docs = B.with_blocks(frame.filter(long), total, id_col, text)
    period = period_for(size)
    buckets = max(1, total * 8 * len(COVERS[period]) // (period * _WORD_BYTES * B.BUCKET_BYTES))
    first = docs.groupBy("block").applyInArrow(_emit_anchors(size, buckets), B.PACKED).groupBy("bucket").applyInArrow(_answer, B.PACKED)
    second = docs.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_emit_windows(size, buckets), B.PACKED).groupBy("bucket").applyInArrow(_answer, B.PACKED)
    kept = docs.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(_delete(size), RESULT)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    short = frame.filter(~long).select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    return kept.unionByName(short.select("doc_id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("words", " ").alias("kept")))
