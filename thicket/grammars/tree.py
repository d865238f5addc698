"""Trees that grammars build, and their node rows."""

from __future__ import annotations

import bisect


class Tree:
    """A node with children in order; offsets are bytes."""

    __slots__ = ("kind", "named", "start", "end", "field", "children", "error")

    def __init__(self, kind: str, start: int, end: int, named: bool = True, field: str | None = None, children: list | None = None, error: bool = False) -> None:
        self.kind, self.start, self.end, self.named, self.field, self.children, self.error = kind, start, end, named, field, children or [], error

    def add(self, child: Tree, field: str | None = None) -> Tree:
        if field:
            child.field = field
        self.children.append(child)
        return child


def rows(root: Tree, data: bytes, kinds: set[str] | None = None, with_text: bool = True) -> list[tuple]:
    """Node rows in pre-order, as in schema.NODES without file_id; only of ``kinds`` if given."""
    starts = [0]
    at = data.find(b"\n")
    while at >= 0:
        starts.append(at + 1)
        at = data.find(b"\n", at + 1)

    def place(offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, offset) - 1
        return line + 1, offset - starts[line]

    # number first: descendants are counted from the back
    order: list[tuple] = []
    stack = [(root, None, 0, 0, 0, True, True)]
    while stack:
        node, parent, depth, sibling, named, last, last_named = stack.pop()
        number = len(order)
        order.append((node, parent, depth, sibling, named, last, last_named))
        final = max((i for i, c in enumerate(node.children) if c.named), default=-1)
        seen, below = 0, []
        for i, c in enumerate(node.children):
            below.append((c, number, depth + 1, i, seen, i == len(node.children) - 1, i == final))
            seen += c.named
        stack.extend(reversed(below))
    last_desc = list(range(len(order)))
    for i in range(len(order) - 1, 0, -1):
        p = order[i][1]
        last_desc[p] = max(last_desc[p], last_desc[i])
    out = []
    for i, (n, parent, depth, sibling, named, last, last_named) in enumerate(order):
        if kinds is None or n.kind in kinds:
            (l0, c0), (l1, c1) = place(n.start), place(n.end)
            text = data[n.start : n.end].decode("utf-8", "replace") if with_text else None
            out.append((i, parent, depth, sibling, named, last_desc[i], n.kind, n.named, n.error, bool(n.children), last, last_named, n.field, l0, c0, l1, c1, n.start, n.end, text))
    return out
