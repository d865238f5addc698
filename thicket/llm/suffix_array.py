"""Suffix arrays by linear grouping.

Suffixes are grouped by a common prefix that ends up as their longest Lyndon
prefix. Groups are taken in descending order. Each suffix of a group looks for
the nearest suffix before it that is in a smaller group, by way of the pointers
of those in between; such a *previous smaller* suffix is continued by the group's
prefix, once for every suffix that points to it, so it moves behind the members
of its group that aren't, ordered by that number. When all groups are done, the
order within each follows from the order of what comes after the prefixes: going
up the array, the suffix that ends where the present one starts is the next of
its group, and so are its previous smaller ones until one is placed already.
Nothing is renamed or solved recursively; the work is in proportion to the length.

``suffix_array`` does that for one sequence. ``suffix_arrays`` does it for many
short ones in step: each numpy operation takes the next group, or the next place,
of every sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Symbols of the sequences that go in step.
BATCH = 1 << 20
#: Symbols of one sequence that cost as much as one step of many.
_STEP = 600


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of all suffixes of a sequence of integers, in ascending order."""
    n = len(symbols) + 1  # with an end that is smaller than all
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    order, group, size, previous = [n - 1], [0] * n, [0] * n, [-1] * n
    size[0] = 1
    for c in sorted(by_symbol):
        start, members = len(order), by_symbol[c]
        for i in members:
            group[i] = start
        size[start] = len(members)
        order += members
    place = [0] * n
    for at, i in enumerate(order):
        place[i] = at
    end = n
    while end > 1:
        start = group[order[end - 1]]
        count: dict[int, int] = {}
        for s in order[start:end]:
            p = s - 1
            while p >= 0 and group[p] >= start:
                # of this group, or one done before: go where it points, if it has looked already
                p = previous[p] if group[p] > start or place[p] < 0 else p - 1
            previous[s] = p
            place[s] = -1 - place[s]
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        moved: dict[int, list[tuple[int, int]]] = {}
        for p, k in count.items():
            moved.setdefault(group[p], []).append((k, p))
        for g, pairs in moved.items():
            pairs.sort(reverse=True)
            to, left, i = g + size[g], size[g], 0
            while i < len(pairs):
                k, j = pairs[i][0], i
                while j < len(pairs) and pairs[j][0] == k:
                    p = pairs[j][1]
                    to -= 1
                    other, at = order[to], place[p]
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
                    j += 1
                left -= j - i
                if left:  # else the rest of the group keeps its start
                    for _, p in pairs[i:j]:
                        group[p] = to
                    size[to] = j - i
                    size[g] = left
                i = j
        end = start
    out, filled, done = [0] * n, [0] * n, [False] * n
    out[0], done[n - 1] = n - 1, True
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[g + filled[g]] = s
            filled[g] += 1
            done[s] = True
            s = previous[s]
    return out[1:]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start and count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _in_step(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of sequences laid end to end, longest first: places in ``symbols``, sequence by sequence."""
    many = len(sizes)
    # a mark before each sequence and after the last: the end of the one before, and where pointers stop
    mark = np.r_[0, np.cumsum(sizes + 1)]
    n = int(mark[-1]) + 1
    lane = np.repeat(np.arange(many), sizes)
    spot = np.arange(len(symbols)) + lane + 1
    by = np.argsort(symbols, kind="stable")
    by = by[np.argsort(lane[by].astype(np.uint16) if many < 1 << 16 else lane[by], kind="stable")]
    order, place, group, size, previous = (np.zeros(n, np.int64) for _ in range(5))
    order[spot] = spot[by]
    place[order[spot]] = spot
    key = symbols[by]
    head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lane[1:] != lane[:-1])])
    length = np.diff(np.r_[head, len(symbols)])
    group[order[spot]] = np.repeat(spot[head], length)
    size[spot[head]] = length
    group[mark] = -1
    target = np.zeros(n, bool)
    first, end = mark[:-1] + 1, mark[1:].copy()
    live = np.flatnonzero(end > first)
    while len(live):
        start = group.take(order.take(end.take(live) - 1))
        count = end.take(live) - start
        members = order.take(ranges(start, count))
        own = np.repeat(start, count)
        end[live] = start
        live = live[start > first.take(live)]
        to = members - 1
        previous[members] = to
        # members of the group point on by way of each other's pointers, so a run of them takes few turns
        at, p, least = members, to, own
        while True:
            on = np.flatnonzero(group.take(p) >= least)
            if not len(on):
                break
            at, least = at.take(on), least.take(on)
            p = previous.take(p.take(on))
            previous[at] = p
        to = previous.take(members)
        to = to[group.take(to) >= 0]
        if not len(to):
            continue
        to.sort()
        head = _heads(to[1:] != to[:-1])
        times = _sizes(head, len(to))
        to = to.take(head)
        of = group.take(to)
        by = np.argsort((of << 24) + times, kind="stable")
        to, times, of = to.take(by), times.take(by), of.take(by)
        new = of[1:] != of[:-1]
        head = _heads(new)
        taken = _sizes(head, len(to))
        of = of.take(head)
        left = size.take(of) - taken
        room = ranges(of + left, taken)
        there = order.take(room)
        outside = to != there
        if outside.any():
            target[to] = True
            displaced = there[~target.take(there)]
            target[to] = False
            now = place.take(to)
            vacant = now[now < np.repeat(of + left, taken)]
            order[vacant], place[displaced] = displaced, vacant
            order[room], place[to] = to, room
        size[of] = left
        head = _heads(new | (times[1:] != times[:-1]))
        taken = _sizes(head, len(to))
        start = room.take(head)
        group[to] = np.repeat(start, taken)
        size[start] = taken
    out, filled, done = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    out[mark[:-1]] = mark[1:]
    done[mark] = True
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), "right")  # sequences with so many symbols or more
    for at, lanes in enumerate(alive.tolist()):
        s = out.take(mark[:lanes] + at) - 1
        while True:
            s = s[~done.take(s)]
            if not len(s):
                break
            g = group.take(s)
            now = filled.take(g)
            out[g + now] = s
            filled[g] = now + 1
            done[s] = True
            s = previous.take(s)
    return out[spot] - lane - 1


def _heads(new: np.ndarray) -> np.ndarray:
    """Where runs start, from where a value differs from the one before."""
    out = np.flatnonzero(new)
    return np.concatenate((_ZERO, out + 1))


def _sizes(heads: np.ndarray, total: int) -> np.ndarray:
    out = np.empty(len(heads), np.int64)
    np.subtract(heads[1:], heads[:-1], out=out[:-1])
    out[-1] = total - heads[-1]
    return out


_ZERO = np.zeros(1, np.int64)


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of sequences of the given sizes laid end to end: places in ``symbols``, sequence by sequence."""
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(len(symbols), np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[order[at:]]), BATCH, "right")))
        chosen = order[at:to]
        if int(sizes[chosen].sum()) < _STEP * int(sizes[chosen[0]]):
            # the longest would take most steps by itself
            i = int(chosen[0])
            part = slice(int(starts[i]), int(starts[i] + sizes[i]))
            out[part] = np.array(suffix_array(symbols[part].tolist()), np.int64) + starts[i]
            at += 1
            continue
        where = ranges(starts[chosen], sizes[chosen])
        out[where] = where[_in_step(symbols[where], sizes[chosen])]
        at = to
    return out
