"""The sieve: which files can't match a query, told by their filters.

``required`` finds texts that every match must hold: values of ``#eq?`` on nodes
that aren't optional, and anonymous tokens of mandatory nodes. Values of
``#any-of?`` are alternatives. Regular expressions and negations require nothing,
so no file that matches is ever rejected. ``quoted`` is the older rule that takes
every quoted text of the query as required; it can reject files that match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions import trigram
from thicket.plans import sexpr

_QUOTED = re.compile(r'"((?:\\.|[^"\\])*)"', re.S)


def required(query: str) -> list[list[list[str]]]:
    """For each pattern, groups of alternatives: one text of each group must occur."""
    out = []
    for pattern in sexpr.parse(query):
        sure, names = [], set()

        def visit(n, optional, sure=sure, names=names):
            optional = optional or n.quantifier in ("?", "*")
            if not optional:
                names.update(n.captures)
                if n.named is False and n.kind:
                    sure.append([n.kind])
                for c in n.children:
                    visit(c, optional)

        visit(pattern.root, False)
        for p in pattern.predicates:
            if p.capture in names and p.other is None and p.name in ("#eq?", "#any-of?"):
                sure.append(p.values)
        out.append(sure)
    return out


def quoted(query: str) -> list[str]:
    """All non-empty quoted texts of a query, escapes left as they are."""
    return [x for x in _QUOTED.findall(query) if x]


def accepts(bits: Column, queries: list[str], compat: bool = False) -> Column:
    """Whether a file with these filter bits can match one of the queries; null bits: it can."""
    found = F.lit(False)
    if compat:
        wanted = [sorted({int(b) for x in quoted(q) for b in trigram.bits_of(x.encode())}) for q in queries]
        if not any(wanted):
            return F.lit(True)
        for w in wanted:
            if w:
                found = found | trigram.contains_all(bits, w)
    else:
        for q in queries:
            for groups in required(q):
                whole = F.lit(True)
                for group in groups:
                    one = F.lit(False)
                    for text in group:
                        one = one | trigram.contains_all(bits, trigram.bits_of(text.encode()))
                    whole = whole & one
                found = found | whole
    return F.coalesce(found, F.lit(True))
