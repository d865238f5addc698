"""Vectorised hashes of words and of windows, over the UTF-8 bytes of many texts at once.

``word_hashes`` has 128 bits and decides equality. ``span_hashes`` and ``rolling``
are polynomials modulo 2^64, which some long strings are known to defeat: they
name features and find candidates only.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: Bytes hashed with one table of powers; longer only where one word is longer.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=U64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

#: White space of the word pattern [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that near inputs get far outputs."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``size`` of each."""
    global _powers
    if len(_powers[0]) < size:
        n = max(size, 1 << 16)
        made = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(n, factor, U64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers = (made[0], made[1])
    return _powers


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a blank after each text, and where each text starts (one more entry: the end)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=bounds[1:])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), bounds


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end; the buffer ends with a blank."""
    word = np.zeros(len(buffer) + 1, np.int8)
    word[1:] = ~BLANK[buffer]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans are in order and don't overlap."""
    out, at, n = np.empty(len(starts), U64), 0, len(starts)
    while at < n:
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + SEGMENT, "right")), at + 1)
        part = buffer[base : ends[to - 1]]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U64)
        at = to
    return mix(out)


#: Bytes of words that are hashed eight at a time; longer ones go one by one.
_SHORT = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each byte span; the first tells all spans of eight bytes or less and one length apart."""
    size = ends - starts
    raw = buffer.tobytes() + bytes(_SHORT)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    a, b = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93)), mix(size.astype(U64) + U64(0xA24BAED4963EE407))
    for k in range(0, _SHORT, 8):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        part = eight[starts[at] + k] & _MASKS[np.minimum(size[at] - k, 8)]
        a[at] = mix(a[at] ^ part)
        b[at] = mix((b[at] + part) * U64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(size > _SHORT).tolist():
        a[i], b[i] = np.frombuffer(xxhash.xxh3_128_digest(raw[starts[i] : ends[i]]), "<u8")
    return a, b


def rolling(buffer: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes of a short buffer."""
    up, down = powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, U64)
    np.cumsum(_TABLE[buffer] * up[: len(buffer)], out=sums[1:])
    x = (sums[size:] - sums[:-size]) * down[: len(buffer) - size + 1]
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def windows(symbols: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of ``size`` symbols, put together from windows of powers of two. Windows may cross texts; callers mask those."""
    if len(symbols) < size:
        return np.empty(0, U64)
    power, width, whole, length = mix(symbols ^ U64(seed)), 1, None, 0
    while True:
        if size & width:
            if whole is None:
                whole, length = power, width
            else:
                n = len(symbols) - length - width + 1
                whole, length = mix(whole[:n] * U64(0xD6E8FEB86659FD93) + power[length : length + n]), length + width
        if length == size:
            return whole
        n = len(symbols) - 2 * width + 1
        power, width = mix(power[:n] * U64(0xA24BAED4963EE407) + power[width : width + n]), 2 * width
