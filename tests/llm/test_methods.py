"""The inner parts against plain versions."""

import random

import numpy as np
import pyarrow as pa

from thicket.llm import blockwise, hashing, simhash, suffix_dedup
from thicket.llm.suffix_array import suffix_array, suffix_arrays


def test_suffix_array():
    draw = random.Random(5)
    for _ in range(500):
        s = [draw.randrange(draw.choice([1, 2, 4])) for _ in range(draw.randrange(30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_in_step(monkeypatch):
    draw = random.Random(6)
    for step in (0, 10**9):  # all in step, and all by themselves
        monkeypatch.setattr("thicket.llm.suffix_array._STEP", step)
        for batch in (50, 1 << 20):
            monkeypatch.setattr("thicket.llm.suffix_array.BATCH", batch)
            for _ in range(30):
                parts = [[draw.randrange(draw.choice([1, 2, 4, 300])) for _ in range(draw.randrange(40))] for _ in range(draw.randrange(1, 30))]
                got = suffix_arrays(np.array([x for p in parts for x in p], np.int16), np.array([len(p) for p in parts])).tolist()
                at = 0
                for p in parts:
                    assert [x - at for x in got[at : at + len(p)]] == sorted(range(len(p)), key=lambda i: p[i:])  # noqa: B023
                    at += len(p)


def test_close_pairs():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(draw.integers(0, 64))) for _ in range(20)] + [base]))
    group = np.sort(draw.integers(0, 3, len(fps)))
    order = np.lexsort((simhash.gray_rank(fps), group))
    fps, group = fps[order], group[order]
    a, b = simhash.close_pairs(fps, group)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_windows_are_told_apart():
    symbols = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.uint64)
    for size in (1, 2, 3, 5, 7, 8):
        got = hashing.windows(symbols, size)
        plain = [tuple(symbols[i : i + size].tolist()) for i in range(len(symbols) - size + 1)]
        assert len(got) == len(plain)
        assert all((got[i] == got[j]) == (plain[i] == plain[j]) for i in range(len(plain)) for j in range(len(plain)))


def _run(texts, crowd, monkeypatch):
    """The stages of suffix_dedup over three blocks, without a session."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    tables = {b: pa.table({"doc_id": pa.array([i for i in range(len(texts)) if i % 3 == b], pa.int64()), "text": pa.array([t for i, t in enumerate(texts) if i % 3 == b], pa.binary())}) for b in range(3)}
    key = {b: (pa.scalar(b),) for b in tables}

    def for_block(rows, b):
        return rows.filter(pa.compute.equal(rows["block"], b))

    def every(emit, answers, replies):
        rows = pa.concat_tables([emit(100, 1)(key[b], t, for_block(replies, b)) for b, t in tables.items()])
        return pa.concat_tables([answer(rows) for answer in answers])

    known = suffix_dedup._answer_minimizers(pa.concat_tables([suffix_dedup._emit_minimizers(100, 1)(key[b], t) for b, t in tables.items()]))
    known = pa.concat_tables([known, every(suffix_dedup._emit_segments, [suffix_dedup._answer_segments], known)])
    known = pa.concat_tables([known, every(suffix_dedup._emit_bodies, [suffix_dedup._answer_windows, suffix_dedup._compare(100)], known)])
    last = pa.concat_tables([known, every(suffix_dedup._emit_windows, [suffix_dedup._compare(100)], known)])
    out = {}
    for b, t in tables.items():
        for r in suffix_dedup._delete(100)(t, for_block(last, b)).to_pylist():
            out[r["doc_id"]] = r["kept"]
    return out


def test_suffix_dedup_over_blocks(monkeypatch):
    draw = random.Random(9)
    passages = [bytes(draw.choice(b"abcdefg ") for _ in range(n)) for n in (99, 100, 130, 400)]
    texts = [b"".join(draw.choice([*passages, bytes(draw.choice(b"xyz ") for _ in range(60)), b"ab" * 90]) for _ in range(draw.randrange(1, 6))) for _ in range(30)] + [b"", b"q" * 300, b"q" * 99]
    texts += texts[:3] + [bytes(draw.choice(b"xyz ") for _ in range(k)) + passages[3] + b"0" * k for k in (1, 2, 40, 41, 42, 43)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = set()
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(t[k : k + 100])
        want[i] = bytes(c for k, c in enumerate(t) if k not in gone)
    for crowd in (1, 64):
        assert _run(texts, crowd, monkeypatch) == want
    # nothing but whole copies goes without the suffix arrays
    monkeypatch.setattr(suffix_dedup, "window_classes", lambda *_: (np.empty(0, np.int64),) * 3)
    for crowd in (1, 64):
        got = _run(texts, crowd, monkeypatch)
        assert all(got[i] == (b"" if t in texts[:i] and len(t) >= 100 else t) for i, t in enumerate(texts))


def test_first_of_each():
    a = np.array([5, 3, 5, 3, 9], np.uint64)
    index, first = blockwise.first_of_each(a, a)
    assert first.tolist() == [True, True, False, False, True] and set(index.tolist()) == {0, 1, 4}
