"""Patterns to DataFrame joins over a node table.

Each pattern node is a selection of the node table, each nesting an equi-join on
file and parent, and the order of siblings a residual of that join. Anchors are
filters, as the parser numbers named siblings. One row comes out for each capture.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.plans.sexpr import Node, Pattern, Predicate, java_regex
from thicket.schema import QueryCompileError

_PLACE = ["start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte"]
#: nodes(kinds or None, with_text, with_path, columns, texts or None) -> the node table, with those kinds, columns and texts at least.
Nodes = Callable[[set[str] | None, bool, bool, list[str], list[str] | None], DataFrame]


def check(pattern: Pattern, grammar) -> None:
    """Raise QueryCompileError if the grammar hasn't the pattern's kinds, tokens and fields."""
    for n in pattern.root.walk():
        if n.kind is not None and n.kind not in (grammar.kinds if n.named else grammar.anonymous) and n.kind != "ERROR":
            raise QueryCompileError(f"no node kind {n.kind!r}")
        for name in [*([n.field] if n.field else []), *n.absent]:
            if name not in grammar.fields:
                raise QueryCompileError(f"no field {name!r}")


def _condition(p: Predicate, text: Column, other: Column | None) -> Column:
    if p.name == "#eq?":
        found = text == (other if other is not None else F.lit(p.values[0]))
    elif p.name == "#not-eq?":
        found = text != (other if other is not None else F.lit(p.values[0]))
    elif p.name == "#any-of?":
        found = text.isin(p.values)
    else:
        found = text.rlike(java_regex(p.values[0]))
        found = ~found if p.name == "#not-match?" else found
    return F.coalesce(found, F.lit(False))


def match(pattern: Pattern, nodes: Nodes, with_path: bool = False) -> DataFrame:
    """(file_id, path?, place, capture_name, matched_text) of a plain pattern; rows may repeat."""
    if not pattern.plain:
        raise QueryCompileError("quantifiers and alternations aren't joins; use the per-file matcher")
    flat: list[tuple[int, int | None, int | None, Node]] = []  # own number, parent's, elder sibling's

    def number(n: Node, parent: int | None) -> int:
        own = len(flat)
        flat.append((own, parent, None, n))
        elder = None
        for c in n.children:
            at = number(c, own)
            flat[at] = (at, own, elder, c)
            elder = at
        return own

    number(pattern.root, None)
    owner = {c: i for i, _, _, n in flat for c in n.captures}
    of = lambda i, c: F.col(f"n{i}_{c}")

    def table(i: int, n: Node, first: bool) -> DataFrame:
        need_text = bool(n.captures)
        kept = [*(["file_id", "node_id", "parent_id", "sibling_idx", "named_idx"] if len(flat) > 1 or n.absent else ["file_id"]), *(["is_named", "kind", "text", *_PLACE] if n.captures else [])]
        tests = [*(["kind"] if n.kind else []), *(["is_named"] if n.named is not None else []), *(["field_name"] if n.field else []), *(["named_idx", "sibling_idx"] if n.first else []), *(["is_last_named", "is_last"] if n.last else [])]
        texts = next((p.values for p in pattern.predicates if p.other is None and owner[p.capture] == i and p.name in ("#eq?", "#any-of?")), None)
        found = nodes({n.kind} if n.kind else None, need_text, with_path and first, list(dict.fromkeys([*kept, *tests])), texts)
        conditions = [F.col("kind") == n.kind] if n.kind else []
        if n.named is not None:
            conditions.append(F.col("is_named") == n.named)
        if n.field:
            conditions.append(F.col("field_name") == n.field)
        if n.first:
            conditions.append(F.col("named_idx" if n.named else "sibling_idx") == 0)
        if n.last:
            conditions.append(F.col("is_last_named" if n.named else "is_last"))
        for p in pattern.predicates:  # tests of one node filter its own scan
            if p.other is None and owner[p.capture] == i:
                conditions.append(_condition(p, F.col("text"), None))
        found = reduce(DataFrame.filter, conditions, found)
        return found.select(*(F.col(c).alias(f"n{i}_{c}") for c in [*kept, *(["path"] if with_path and first else [])]))

    whole = table(0, pattern.root, True)
    for i, parent, elder, n in flat[1:]:
        on = [of(parent, "file_id") == of(i, "file_id"), of(parent, "node_id") == of(i, "parent_id")]
        if elder is not None:
            if n.adjacent:
                on.append(of(i, "named_idx") == of(elder, "named_idx") + 1 if n.named and flat[elder][3].named else of(i, "sibling_idx") == of(elder, "sibling_idx") + 1)
            else:
                on.append(of(i, "sibling_idx") > of(elder, "sibling_idx"))
        whole = whole.join(table(i, n, False), on)
    for i, _, _, n in flat:
        for name in n.absent:
            held = nodes(None, False, False, ["file_id", "parent_id", "field_name"], None).filter(F.col("field_name") == name).select(F.col("file_id").alias("x_file"), F.col("parent_id").alias("x_parent"))
            whole = whole.join(held, (of(i, "file_id") == F.col("x_file")) & (of(i, "node_id") == F.col("x_parent")), "left_anti")
    for p in pattern.predicates:
        if p.other is not None:
            whole = whole.filter(_condition(p, of(owner[p.capture], "text"), of(owner[p.other], "text")))
    captured = [
        F.struct(*(of(i, c).alias(c) for c in _PLACE), F.when(of(i, "is_named"), F.lit(c)).otherwise(F.concat(F.lit(f"{c}["), of(i, "kind"), F.lit("]"))).alias("capture_name"), of(i, "text").alias("matched_text"))
        for i, _, _, n in flat
        for c in n.captures
    ]
    keep = [of(0, "file_id").alias("file_id"), *([of(0, "path").alias("file_path")] if with_path else [])]
    if not captured:  # a query without captures shows nothing
        captured = [F.struct(*(F.lit(None).cast("int").alias(c) for c in _PLACE), F.lit("").alias("capture_name"), F.lit("").alias("matched_text"))]
    rows = whole.select(*keep, F.explode(F.array(*captured)).alias("m")) if len(captured) > 1 else whole.select(*keep, captured[0].alias("m"))
    return rows.select(*(c for c in ("file_id", "file_path") if c in rows.columns), "m.*").filter(F.length("matched_text") > 0)
