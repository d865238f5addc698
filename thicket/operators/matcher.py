"""The per-file matcher: all patterns over one tree, with alternations and quantifiers."""

from __future__ import annotations

import bisect
import re
from itertools import accumulate

from thicket.grammars.tree import Tree
from thicket.plans.sexpr import Node, Pattern


def _is(p: Node, n: Tree) -> bool:
    if p.kind is not None and p.kind != n.kind and not (p.kind == "ERROR" and n.error):
        return False
    if p.named is not None and p.named != n.named:
        return False
    if p.field and p.field != n.field:
        return False
    return not any(c.field in p.absent for c in n.children) if p.absent else True


def _matches(p: Node, n: Tree):
    """Yield bindings (lists of capture and node) of pattern node p at tree node n."""
    if p.options:
        if p.field and p.field != n.field:
            return
        for option in p.options:
            for found in _matches(option, n):
                yield [(c, n) for c in p.captures] + found
        return
    if not _is(p, n):
        return
    own = [(c, n) for c in p.captures]
    if not p.children:
        yield own
        return
    for found in _sequence(p.children, 0, n.children, 0, -1):
        yield own + found


def _sequence(patterns: list[Node], i: int, children: list[Tree], start: int, before: int, seen: list[int] | None = None):
    """Bindings of patterns[i:] to children from ``start``; ``before``: the child that the pattern before took."""
    if i == len(patterns):
        yield []
        return
    if seen is None:  # named children before each
        seen = [0, *accumulate(c.named for c in children)]
    p, hits = patterns[i], []
    counts = seen if p.named is not False else range(len(children) + 1)
    for k in range(start, len(children)):
        if p.first and counts[k] or p.adjacent and counts[k] > counts[before + 1]:
            break
        if p.last and counts[-1] > counts[k + 1]:
            continue
        if p.quantifier in ("*", "+"):
            found = next(_matches(p, children[k]), None)
            if found is not None:
                hits.append((k, found))
            continue
        for found in _matches(p, children[k]):
            for rest in _sequence(patterns, i + 1, children, k + 1, k, seen):
                hits.append(())
                yield found + rest
    if p.quantifier in ("*", "+") and hits:
        # as many as there are if the rest still matches, else as many as leave it room
        for n in range(len(hits), 0, -1):
            some = False
            for rest in _sequence(patterns, i + 1, children, hits[n - 1][0] + 1, hits[n - 1][0], seen):
                some = True
                yield [x for _, b in hits[:n] for x in b] + rest
            if some:
                return
    elif p.quantifier in ("*", "?") and not hits:
        yield from _sequence(patterns, i + 1, children, start, before, seen)


def _holds(pattern: Pattern, binding: list[tuple[str, Tree]], data: bytes) -> bool:
    def text(name):
        node = next((n for c, n in binding if c == name), None)
        if node is None:
            return None
        try:
            return data[node.start : node.end].decode()
        except UnicodeDecodeError:
            return None

    for p in pattern.predicates:
        own, other = text(p.capture), text(p.other) if p.other else p.values[0] if p.values else None
        if own is None:
            return False
        if p.name == "#eq?" and own != other or p.name == "#not-eq?" and own == other or p.name == "#any-of?" and own not in p.values:
            return False
        if p.name == "#match?" and not _search(p.values[0], own) or p.name == "#not-match?" and _search(p.values[0], own):
            return False
    return True


def _search(regex: str, text: str) -> bool:
    # $ is the very end, as in the joins' dialect
    out, in_class, at = [], False, 0
    while at < len(regex):
        c = regex[at]
        if c == "\\" and at + 1 < len(regex):
            out.append(regex[at : at + 2])
            at += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append("\\Z" if c == "$" and not in_class and not re.match(r"\(\?[a-z]*m", regex) else c)
        at += 1
    return re.search("".join(out), text) is not None


def bindings(pattern: Pattern, root: Tree, data: bytes):
    """All bindings of a pattern in a tree that fulfil its predicates."""
    stack = [root]
    while stack:
        n = stack.pop()
        for found in _matches(pattern.root, n):
            if _holds(pattern, found, data):
                yield found
        stack.extend(reversed(n.children))


def match(patterns: list[Pattern], root: Tree, data: bytes) -> list[tuple]:
    """Distinct (start_line, start_col, end_line, end_col, start_byte, end_byte, capture_name, matched_text) in order."""
    starts = [0, *(m.end() for m in re.finditer(b"\n", data))]

    def place(offset):
        line = bisect.bisect_right(starts, offset)
        return line, offset - starts[line - 1]

    out = set()
    for pattern in patterns:
        for found in bindings(pattern, root, data):
            for name, n in found:
                try:
                    text = data[n.start : n.end].decode()
                except UnicodeDecodeError:
                    continue
                if text:
                    out.add((*place(n.start), *place(n.end), n.start, n.end, name if n.named else f"{name}[{n.kind}]", text))
    return sorted(out)


def place(data: bytes, offset: int) -> tuple[int, int]:
    """Line from 1 and byte column from 0."""
    return data.count(b"\n", 0, offset) + 1, offset - (data.rfind(b"\n", 0, offset) + 1)
