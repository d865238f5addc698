"""Substring dedup on bytes: delete every byte that lies in a string of ``size`` bytes which also starts earlier.

Equal windows of ``size`` bytes have their *minimizer*, the least hash of the
32-byte strings in them, at the same place. A text is cut into segments: runs of
windows with one minimizer, so a segment has less than 2 ``size`` bytes. Which
windows are equal is decided by suffix arrays, built by linear grouping
(``suffix_array``), over the segments that share a minimizer: neighbours in the
array that agree in ``size`` bytes are one class, and only the earliest place of a
class keeps its bytes. All else serves to bring few bytes together:

1. Blocks exchange their distinct minimizers, and a digest of each whole text.
   Later copies of a whole text are deleted by that digest; segments whose
   minimizer occurs once are out.
2. Blocks exchange digests of their distinct segments. A segment that many
   blocks hold is sent by its earliest owner alone; the others only ask about it.
3. The segments of a minimizer meet in one bucket, each different one once, and
   enter a suffix array. A minimizer of more than ``CROWD`` different segments (a
   passage everywhere in different surroundings) would make its bucket grow with
   the corpus, so there the key is made finer: it is the hash of the window, and
   blocks exchange those first.
4. Of a crowd, windows that occur more than once are sent by their earliest owner
   and enter suffix arrays by that key.

What a class says is sent back to the blocks, which delete.

Defined results: null text is empty. Order of documents: id, null ids last, equal
ids by text within a block and by block otherwise; equal rows count as documents
of their own, the first keeps its bytes. Strings never cross documents. Texts
shorter than ``size`` bytes are returned as they are and enter no block. The
result has the columns below only, so clashing extra columns don't matter; the
kept bytes needn't be valid UTF-8. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import blockwise as B
from thicket.llm import hashing as H
from thicket.llm.suffix_array import ranges, suffix_arrays

#: Bytes of the strings that minimizers are chosen from.
GRAM = 32
#: Different segments of a minimizer that meet in one bucket at most.
CROWD = 1024
#: Bytes whose segments are found together; places within it take 17 bits.
PIECE = 1 << 16
#: Symbols that a bucket gives to suffix arrays at once.
ROUND = 4 << 20

MINIMIZER, COPY, SEGMENT, STATE, BODY, ASK, RUN, WINDOW, OWNER = range(9)
#: A segment's minimizer, digest, owner, and whether its block holds it several times.
_SEGMENT = np.dtype([("mini", "<u8"), ("hash", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("none", "u1"), ("many", "u1")])
_STATE = np.dtype([("hash", "<u8"), ("more", "<u8"), ("state", "u1")])
_FIRST, _CROWD = 1, 2
#: Sent with a segment's bytes; spot: number of the document in its block.
_HEAD = np.dtype([("key", "<u8"), ("hash", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("spot", "<i8"), ("start", "<i8"), ("size", "<i4"), ("none", "u1"), ("many", "u1")])
_ASK = np.dtype([("hash", "<u8"), ("more", "<u8")])
#: Windows of a segment that are late where it stands first (first = 1), or elsewhere.
_RUN = np.dtype([("hash", "<u8"), ("more", "<u8"), ("start", "<i4"), ("count", "<i4"), ("first", "u1")])

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def segments(buffer: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in the buffer of joined texts, number of windows and minimizer of each segment, in order.

    Of the hashes the leading 47 bits are compared, and of equals the leftmost is taken.
    """
    gram = min(GRAM, size)
    width, mask, out, ends = size - gram + 1, H.U64(0x1FFFF), [], bounds[1:] - 1
    for at in range(0, max(0, len(buffer) - size + 1), PIECE):
        n = min(PIECE, len(buffer) - size + 1 - at)
        grams = H.rolling(buffer[at : at + n + size - 1], gram)
        place = (_sliding_least((grams & ~mask) | np.arange(len(grams)).astype(H.U64), width) & mask).astype(np.int32)
        # windows that hold the end of a text
        near = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + n + size - 1)] - at
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.maximum(near - size + 1, 0), 1)
        np.add.at(step, np.minimum(near + 1, n), -1)
        inside = np.cumsum(step[:-1]) == 0
        new = inside.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        head = np.flatnonzero(new)
        last = inside.copy()
        last[:-1] &= new[1:] | ~inside[1:]
        out.append((head + at, np.flatnonzero(last) - head + 1, place[head].astype(np.int64) + at, grams[place[head]]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, H.U64)
    start, count, place, mini = (np.concatenate(x) for x in zip(*out, strict=True))
    # a segment that goes on in the next piece has its minimizer at the same place
    goes_on = np.r_[False, (place[1:] == place[:-1]) & (start[1:] == start[:-1] + count[:-1])] if len(start) else np.empty(0, bool)
    head = np.flatnonzero(~goes_on)
    count = np.add.reduceat(count, head) if len(head) else count
    start, mini = start[head], mini[head]
    return np.searchsorted(bounds, start, "right") - 1, start, count, mini


class _Block:
    """A block's texts, and those of its segments that still matter."""

    def __init__(self, table: pa.Table, size: int) -> None:
        self.size, self.texts = size, B.Texts(table)
        self.buffer, self.bounds = H.join_texts(self.texts.texts)
        self.doc, self.start, self.count, self.mini = segments(self.buffer, self.bounds, size)

    def _keep(self, which: np.ndarray) -> None:
        self.doc, self.start, self.count, self.mini = self.doc[which], self.start[which], self.count[which], self.mini[which]

    def shared(self, replies: pa.Table) -> None:
        """Keep segments of shared minimizers outside whole copies. ``once``: one of each, the earliest; ``which``: for each segment, its number among those."""
        known, _ = B.gathered(replies, COPY, B.PAIR)
        self.copied = self.texts.again | B.pair_among(self.texts.a, self.texts.b, known)
        self._keep(~self.copied[self.doc])
        known, _ = B.gathered(replies, MINIMIZER, B.HASH)
        _, first = B.first_of_each(self.mini, self.mini)
        self._keep(B.is_among(self.mini, known) | B.is_among(self.mini, np.unique(self.mini[~first])))
        whole = self.buffer.tobytes()
        self.a, self.b = B.digests(whole[s:e] for s, e in zip(self.start.tolist(), (self.start + self.count + self.size - 1).tolist(), strict=True))
        self.whole = whole
        self.once, self.which, self.many = _classes(self.a, self.b)

    def states(self, replies: pa.Table) -> np.ndarray:
        """For each of ``once``: what is known of it; 0: it has no company."""
        states, _ = B.gathered(replies, STATE, _STATE)
        states = states[np.lexsort((states["more"], states["hash"]))]
        at = B.index_among(self.a[self.once], self.b[self.once], states["hash"].copy(), states["more"].copy())
        return np.where(at >= 0, np.r_[states["state"], np.uint8(0)][at] | 4, 0)

    def body(self, i: int, skip: int = 0, windows: int | None = None) -> bytes:
        start = int(self.start[i]) + skip
        return self.whole[start : start + (int(self.count[i]) if windows is None else windows) + self.size - 1]

    def crowd(self, states: np.ndarray) -> None:
        """All windows of the crowds: segment and place of each, digests, and one of each, the earliest."""
        of = np.flatnonzero((states & _CROWD) > 0)
        segment = np.flatnonzero(np.isin(self.which, of))
        self.w_segment = np.repeat(segment, self.count[segment])
        self.w_start = ranges(self.start[segment], self.count[segment])
        self.w_a, self.w_b = B.digests(self.whole[s : s + self.size] for s in self.w_start.tolist())
        self.w_once, self.w_which, self.w_many = _classes(self.w_a, self.w_b)

    def heads(self, doc: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, many: np.ndarray) -> np.ndarray:
        out = np.empty(len(doc), _HEAD)
        for name, values in (("key", key), ("hash", a), ("more", b), ("doc", self.texts.ids[doc]), ("none", self.texts.none[doc]), ("spot", doc), ("start", start - self.bounds[doc]), ("size", size), ("many", many)):
            out[name] = values
        return out


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Earliest of each value (a, b), for every value its class, and which classes have several."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    once = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return once, which, np.bincount(which, minlength=len(once)) > 1


def _sent(number: int, heads: np.ndarray, bodies: list[bytes], buckets: int):
    """Rows of heads and bytes, each bucket's together."""
    to = B.bucket_of(heads["key"], buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        packed = len(part).to_bytes(8, "little") + heads[part].tobytes() + b"".join([bodies[i] for i in part.tolist()])
        yield int(to[part[0]]), number, BODY, packed


def _emit_minimizers(size: int, buckets: int):
    def run(key, table):
        block, number = _Block(table, size), key[0].as_py()
        minis = np.unique(block.mini)
        once = np.flatnonzero(~block.texts.again)
        records = block.texts.owned(once, block.texts.a[once], block.texts.b[once])
        return B.table_of([*B.deal(number, MINIMIZER, minis, minis, buckets), *B.deal(number, COPY, records, records["hash"], buckets)])

    return run


def _answer_minimizers(table):
    minis, blocks = B.gathered(table, MINIMIZER, B.HASH)
    twice = B.in_several_blocks(minis, blocks)
    rows = [*B.answers(MINIMIZER, minis[twice], blocks[twice])]
    records, blocks = B.gathered(table, COPY, B.OWNED)
    late = B.owned_elsewhere(records, blocks)
    return B.table_of([*rows, *B.answers(COPY, B.pairs(records[late]), blocks[late])])


def _emit_segments(size: int, buckets: int):
    def run(key, table, replies):
        if not table.num_rows:
            return B.table_of([])
        block = _Block(table, size)
        block.shared(replies)
        i = block.once
        records = np.empty(len(i), _SEGMENT)
        for name, values in (("mini", block.mini[i]), ("hash", block.a[i]), ("more", block.b[i]), ("doc", block.texts.ids[block.doc[i]]), ("none", block.texts.none[block.doc[i]]), ("many", block.many)):
            records[name] = values
        return B.table_of(B.deal(key[0].as_py(), SEGMENT, records, records["mini"], buckets))

    return run


def _answer_segments(table):
    """To all blocks with a segment in company: whether it is the earliest owner, and whether there's a crowd."""
    r, blocks = B.gathered(table, SEGMENT, _SEGMENT)
    if not len(r):
        return B.table_of([])
    order = np.lexsort((blocks, r["doc"], r["none"], r["more"], r["hash"], r["mini"]))
    r, blocks = r[order], blocks[order]
    new_mini = np.r_[True, r["mini"][1:] != r["mini"][:-1]]
    new = new_mini | np.r_[True, (r["hash"][1:] != r["hash"][:-1]) | (r["more"][1:] != r["more"][:-1])]
    head = np.flatnonzero(new_mini)
    members = np.diff(np.r_[head, len(r)])
    different = np.add.reduceat(new.astype(np.int64), head)
    company = np.repeat((members > 1) | (np.maximum.reduceat(r["many"], head) > 0), members)
    states = np.empty(len(r), _STATE)
    states["hash"], states["more"], states["state"] = r["hash"], r["more"], np.where(new, _FIRST, 0) | np.where(np.repeat(different > CROWD, members), _CROWD, 0)
    return B.table_of(B.answers(STATE, states[company], blocks[company]))


def _emit_bodies(size: int, buckets: int):
    def run(key, table, replies):
        if not table.num_rows:
            return B.table_of([])
        block, number = _Block(table, size), key[0].as_py()
        block.shared(replies)
        states = block.states(replies)
        few = (states & (4 | _CROWD)) == 4
        first, rest = np.flatnonzero(few & ((states & _FIRST) > 0)), np.flatnonzero(few & ((states & _FIRST) == 0))
        i = block.once[first]
        heads = block.heads(block.doc[i], block.start[i], block.count[i] + size - 1, block.mini[i], block.a[i], block.b[i], block.many[first])
        i = block.once[rest]
        asks = np.empty(len(i), _ASK)
        asks["hash"], asks["more"] = block.a[i], block.b[i]
        block.crowd(states)
        once = block.w_once
        windows = np.empty(len(once), _SEGMENT)
        doc = block.doc[block.w_segment[once]]
        for name, values in (("mini", block.w_a[once]), ("hash", block.w_a[once]), ("more", block.w_b[once]), ("doc", block.texts.ids[doc]), ("none", block.texts.none[doc]), ("many", block.w_many)):
            windows[name] = values
        bodies = [block.body(k) for k in block.once[first].tolist()]
        return B.table_of([*_sent(number, heads, bodies, buckets), *B.deal(number, ASK, asks, block.mini[i], buckets), *B.deal(number, WINDOW, windows, windows["hash"], buckets)])

    return run


def _emit_windows(size: int, buckets: int):
    """Of crowds: the bytes of windows that occur more than once, by their earliest owner."""

    def run(key, table, replies):
        if not table.num_rows:
            return B.table_of([])
        block, number = _Block(table, size), key[0].as_py()
        block.shared(replies)
        block.crowd(block.states(replies))
        states = _window_states(block, replies)
        first, rest = np.flatnonzero((states & _FIRST) > 0), np.flatnonzero((states > 0) & ((states & _FIRST) == 0))
        i = block.w_once[first]
        heads = block.heads(block.doc[block.w_segment[i]], block.w_start[i], np.full(len(i), size), block.w_a[i], block.w_a[i], block.w_b[i], block.w_many[first])
        bodies = [block.whole[s : s + size] for s in block.w_start[i].tolist()]
        i = block.w_once[rest]
        asks = np.empty(len(i), _ASK)
        asks["hash"], asks["more"] = block.w_a[i], block.w_b[i]
        return B.table_of([*_sent(number, heads, bodies, buckets), *B.deal(number, ASK, asks, asks["hash"], buckets)])

    return run


def _window_states(block: _Block, replies: pa.Table) -> np.ndarray:
    states, _ = B.gathered(replies, OWNER, _STATE)
    states = states[np.lexsort((states["more"], states["hash"]))]
    at = B.index_among(block.w_a[block.w_once], block.w_b[block.w_once], states["hash"].copy(), states["more"].copy())
    return np.where(at >= 0, np.r_[states["state"], np.uint8(0)][at] | 4, 0)


def _equal_windows(raw: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes at places x and y are equal; they may be followed by less than eight others."""
    same = np.ones(len(x), bool)
    if size < 8:
        for k in range(size):
            same &= raw[x + k] == raw[y + k]
        return same
    eight = np.ndarray(len(raw) - 7, "<u8", raw.tobytes(), strides=(1,))
    for k in dict.fromkeys([*range(0, size - 7, 8), size - 8]):
        at = np.flatnonzero(same)
        same[at] = eight[x[at] + k] == eight[y[at] + k]
    return same


def window_classes(bodies: list[bytes], key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows of bodies with one key, by suffix arrays: body, offset and class of every window, by class. Bodies are in order of key."""
    length = np.array([len(x) for x in bodies], np.int64)
    raw = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
    start = np.cumsum(length + 1) - length - 1
    symbols = raw.astype(np.int16) + 1
    symbols[start + length] = 0
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    found = suffix_arrays(symbols, np.add.reduceat(length + 1, head))
    body = np.repeat(np.arange(len(bodies)), length + 1)[found]
    offset = found - start[body]
    ok = offset <= length[body] - size
    found, body, offset = found[ok], body[ok], offset[ok]
    lane = key[body]
    same = np.zeros(len(found), bool)
    same[1:] = lane[1:] == lane[:-1]
    at = np.flatnonzero(same)
    same[at] = _equal_windows(raw, found[at], found[at - 1], size)
    return body, offset, np.cumsum(~same) - 1


def _runs(body: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Body, start and length of runs of offsets."""
    order = np.lexsort((offset, body))
    body, offset = body[order], offset[order]
    head = np.flatnonzero(np.r_[True, (body[1:] != body[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(body) else np.empty(0, np.int64)
    return body[head], offset[head], np.diff(np.r_[head, len(body)])


def _compare(size: int):
    """Suffix arrays over a bucket's segments, and to all who hold one which of its windows are late."""

    def answer(heads, blocks, bodies, asks, askers):
        body, offset, of = window_classes(bodies, heads["key"], size)
        if not len(body):
            return
        # places in order of document and block, numbered
        order = np.lexsort((heads["spot"], blocks, heads["doc"], heads["none"]))
        h, b = heads[order], blocks[order]
        new = np.r_[False, (h["none"][1:] != h["none"][:-1]) | (h["doc"][1:] != h["doc"][:-1]) | (b[1:] != b[:-1]) | (h["spot"][1:] != h["spot"][:-1])]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        place = (rank[body] << 40) + heads["start"][body] + offset
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        late = place > np.minimum.reduceat(place, head)[of]
        # the earliest owner of a segment loses its late windows; all other holders lose every window of a class
        at, start, count = _runs(body[late], offset[late])
        yield _run_records(heads[at], start, count, 1), blocks[at]
        at, start, count = _runs(body, offset)
        many = heads["many"][at] > 0
        yield _run_records(heads[at[many]], start[many], count[many], 0), blocks[at[many]]
        by = np.lexsort((asks["more"], asks["hash"]))
        asks, askers = asks[by], askers[by]
        mine = np.lexsort((heads["more"], heads["hash"]))
        holder = mine[B.index_among(asks["hash"].copy(), asks["more"].copy(), heads["hash"][mine], heads["more"][mine])]
        # runs of each body, for each asker
        first, number = np.searchsorted(at, np.arange(len(heads))), np.bincount(at, minlength=len(heads))
        each = ranges(first[holder], number[holder])
        yield _run_records(heads[at[each]], start[each], count[each], 0), np.repeat(askers, number[holder])

    def run(table):
        rows, heads, blocks, bodies = [], [], [], []
        for kind, number, packed in zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("records").to_pylist(), strict=True):
            if kind == BODY:
                n = int.from_bytes(packed[:8], "little")
                part = np.frombuffer(packed, _HEAD, n, 8)
                ends = 8 + n * _HEAD.itemsize + np.cumsum(part["size"], dtype=np.int64)
                bodies += [packed[e - s : e] for s, e in zip(part["size"].tolist(), ends.tolist(), strict=True)]
                heads.append(part)
                blocks.append(np.full(n, number))
        if heads:
            heads, blocks = np.concatenate(heads), np.concatenate(blocks)
            order = np.argsort(heads["key"], kind="stable")
            heads, blocks, bodies = heads[order], blocks[order], [bodies[i] for i in order.tolist()]
            asks, askers = B.gathered(table, ASK, _ASK)
            mine = np.lexsort((heads["more"], heads["hash"]))
            holder = mine[B.index_among(asks["hash"].copy(), asks["more"].copy(), heads["hash"][mine], heads["more"][mine])]
            # whole keys at a time
            total = np.cumsum(heads["size"], dtype=np.int64)
            edge = np.flatnonzero(np.r_[True, heads["key"][1:] != heads["key"][:-1], True])
            at = 0
            while at < len(heads):
                upto = np.searchsorted(total, (total[at - 1] if at else 0) + ROUND, "right")
                to = int(edge[max(np.searchsorted(edge, upto, "right") - 1, np.searchsorted(edge, at, "right"))])
                here = (holder >= at) & (holder < to)
                for records, numbers in answer(heads[at:to], blocks[at:to], bodies[at:to], asks[here], askers[here]):
                    rows += B.answers(RUN, records, numbers)
                at = to
        return B.table_of(rows)

    return run


def _answer_windows(table):
    """To all blocks with a window in company: whether it is the earliest owner."""
    w, blocks = B.gathered(table, WINDOW, _SEGMENT)
    if not len(w):
        return B.table_of([])
    order = np.lexsort((blocks, w["doc"], w["none"], w["more"], w["hash"]))
    w, blocks = w[order], blocks[order]
    new = np.r_[True, (w["hash"][1:] != w["hash"][:-1]) | (w["more"][1:] != w["more"][:-1])]
    head = np.flatnonzero(new)
    members = np.diff(np.r_[head, len(w)])
    company = np.repeat((members > 1) | (np.maximum.reduceat(w["many"], head) > 0), members)
    states = np.empty(len(w), _STATE)
    states["hash"], states["more"], states["state"] = w["hash"], w["more"], np.where(new, _FIRST, 0)
    return B.table_of(B.answers(OWNER, states[company], blocks[company]))


def _run_records(heads: np.ndarray, start: np.ndarray, count: np.ndarray, first: int) -> np.ndarray:
    out = np.empty(len(heads), _RUN)
    out["hash"], out["more"], out["start"], out["count"], out["first"] = heads["hash"], heads["more"], start, count, first
    return out


def _covered(a: np.ndarray, b: np.ndarray, once: np.ndarray, which: np.ndarray, start: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of windows that runs say are late, for segments (a, b) at ``start``."""
    order = np.lexsort((b[once], a[once]))
    at = B.index_among(runs["hash"].copy(), runs["more"].copy(), a[once][order], b[once][order])
    runs, of = runs[at >= 0], order[at[at >= 0]]
    first = runs["first"] > 0
    places, counts = [start[once[of[first]]] + runs["start"][first]], [runs["count"][first]]
    # others of the same bytes
    runs, of = runs[~first], of[~first]
    by = np.argsort(which, kind="stable")
    low, number = np.searchsorted(which[by], of), np.bincount(which, minlength=len(once))[of]
    each = by[ranges(low, number)]
    again = np.repeat(np.arange(len(runs)), number)
    return each, again, places[0], counts[0], runs


def _delete(size: int):
    def run(table, replies):
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept"), (*[pa.int64()] * 4, pa.binary()), strict=True)})
        block = _Block(table, size)
        block.shared(replies)
        states = block.states(replies)
        block.crowd(states)
        runs, _ = B.gathered(replies, RUN, _RUN)
        step = np.zeros(len(block.buffer) + 1, np.int32)
        w_states = _window_states(block, replies)
        for a, b, once, which, start, known in ((block.a, block.b, block.once, block.which, block.start, states), (block.w_a, block.w_b, block.w_once, block.w_which, block.w_start, w_states)):
            each, again, place, count, rest = _covered(a, b, once, which, start, runs)
            np.add.at(step, place, 1)
            np.add.at(step, place + count + size - 1, -1)
            # the earliest in this block is exempt only where it is the earliest of all
            owner = np.zeros(len(a), bool)
            owner[once] = (known & _FIRST) > 0
            ok = ~owner[each]
            each, again = each[ok], again[ok]
            np.add.at(step, start[each] + rest["start"][again], 1)
            np.add.at(step, start[each] + rest["start"][again] + rest["count"][again] + size - 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        bounds, texts = block.bounds, block.texts.texts
        copied = np.flatnonzero(block.copied)
        gone[ranges(bounds[copied], bounds[copied + 1] - 1 - bounds[copied])] = True
        gone[bounds[1:] - 1] = False  # the blanks between texts
        removed = np.diff(np.r_[0, np.cumsum(gone)][bounds])
        spans = np.diff(np.r_[0, np.cumsum(gone & ~np.r_[False, gone[:-1]])][bounds])
        kept = [texts[d] if not removed[d] else block.buffer[bounds[d] : bounds[d + 1] - 1][~gone[bounds[d] : bounds[d + 1] - 1]].tobytes() for d in range(len(texts))]
        return pa.table({"doc_id": block.texts.arrow_ids(), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return run


def dedupe(frame: DataFrame, size: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes, one row for each input row."""
    long = F.coalesce(F.octet_length(text) >= size, F.lit(False))
    total = B.text_bytes(frame, text)
    docs = B.with_blocks(frame.filter(long), total, id_col, text)
    buckets = max(1, total // (2 * B.BUCKET_BYTES))

    def emitted(replies, emit):
        return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(emit(size, buckets), B.PACKED)

    def answered(rows, answer):
        return rows.groupBy("bucket").applyInArrow(answer, B.PACKED)

    known = answered(docs.groupBy("block").applyInArrow(_emit_minimizers(size, buckets), B.PACKED), _answer_minimizers)
    known = known.unionByName(answered(emitted(known, _emit_segments), _answer_segments))
    bodies = emitted(known, _emit_bodies)
    # what the suffix arrays say is asked for once, at the end, as each use would build them again
    known = known.unionByName(answered(bodies, _answer_windows))
    windows = emitted(known, _emit_windows)
    known = known.unionByName(answered(bodies, _compare(size))).unionByName(answered(windows, _compare(size)))
    kept = docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_delete(size), RESULT)
    n = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    short = frame.filter(~long).select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("kept"))
    return kept.unionByName(short)
