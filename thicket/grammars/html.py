"""A tolerant HTML grammar: elements with tags, attributes, text and comments. Unclosed elements end with their parent."""

from __future__ import annotations

import re

from thicket.grammars import register
from thicket.grammars.tree import Tree

#: Elements without content (fixed values of the format).
VOID = frozenset({b"area", b"base", b"br", b"col", b"embed", b"hr", b"img", b"input", b"link", b"meta", b"param", b"source", b"track", b"wbr"})
#: Elements whose content is no markup.
RAW = frozenset({b"script", b"style"})

_MARK = re.compile(rb"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|</\s*([A-Za-z][^\s>/]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s>/]*)", re.S)
_ATTRIBUTE = re.compile(rb"""\s+|(?P<name>[^\s=>/"']+)(?:(?P<eq>\s*=\s*)(?:"(?P<dq>[^"]*)"?|'(?P<sq>[^']*)'?|(?P<bare>[^\s>"']+)))?|(?P<end>/?>)|.""", re.S)


class HtmlGrammar:
    kinds = frozenset({"document", "doctype", "element", "script_element", "style_element", "start_tag", "self_closing_tag", "end_tag", "tag_name", "attribute", "attribute_name", "attribute_value", "quoted_attribute_value", "text", "raw_text", "comment", "erroneous_end_tag"})
    anonymous = frozenset({"<", ">", "</", "/>", "=", '"', "'"})
    fields: frozenset[str] = frozenset()

    def parse(self, data: bytes) -> Tree:
        root = Tree("document", 0, len(data))
        path, at = [(root, b"")], 0
        while at < len(data):
            m = _MARK.search(data, at)
            self._text(path[-1][0], data, at, m.start() if m else len(data))
            if not m:
                break
            at, parent = m.end(), path[-1][0]
            if m[2] is not None:
                at = self._open(path, data, m)
            elif m[1] is not None:
                name = m[1].lower()
                depth = next((i for i in range(len(path) - 1, 0, -1) if path[i][1] == name), 0)
                tag = Tree("end_tag" if depth else "erroneous_end_tag", m.start(), at, error=not depth)
                tag.add(Tree("</", m.start(), m.start() + 2, False))
                tag.add(Tree("tag_name", m.start(1), m.end(1)))
                if data[at - 1 : at] == b">":
                    tag.add(Tree(">", at - 1, at, False))
                if depth:
                    for node, _ in path[depth + 1 :]:
                        node.end = m.start()
                    path[depth][0].add(tag)
                    path[depth][0].end = at
                    del path[depth:]
                else:
                    parent.add(tag)
            else:
                parent.add(Tree("comment" if data.startswith(b"<!--", m.start()) else "doctype", m.start(), at))
        for node, _ in path[1:]:
            node.end = len(data)
        return root

    def _text(self, parent: Tree, data: bytes, start: int, end: int) -> None:
        body = data[start:end]
        inner = body.strip()
        if inner:
            first = start + len(body) - len(body.lstrip())
            parent.add(Tree("text", first, first + len(inner)))

    def _open(self, path: list, data: bytes, m: re.Match) -> int:
        name, at = m[2].lower(), m.end()
        kind = {b"script": "script_element", b"style": "style_element"}.get(name, "element")
        element = Tree(kind, m.start(), at)
        tag = element.add(Tree("start_tag", m.start(), at))
        tag.add(Tree("<", m.start(), m.start() + 1, False))
        tag.add(Tree("tag_name", m.start(2), m.end(2)))
        closed = False
        while at < len(data):
            a = _ATTRIBUTE.match(data, at)
            at = a.end()
            if a["end"]:
                closed = a["end"] == b"/>"
                tag.add(Tree(a["end"].decode(), a.start(), at, False))
                break
            if a["name"]:
                attribute = tag.add(Tree("attribute", a.start(), at))
                attribute.add(Tree("attribute_name", a.start("name"), a.end("name")))
                for group, quote in (("dq", 1), ("sq", 1), ("bare", 0)):
                    if a[group] is not None:
                        attribute.add(Tree("=", a.end("name"), a.end("eq"), False))
                        holder = attribute.add(Tree("quoted_attribute_value", a.start(group) - 1, at)) if quote else attribute
                        if a.end(group) > a.start(group):
                            holder.add(Tree("attribute_value", a.start(group), a.end(group)))
        tag.end = element.end = at
        path[-1][0].add(element)
        if closed:
            tag.kind = "self_closing_tag"
        elif name in RAW:
            close = re.compile(rb"</" + name + rb"\s*>", re.I).search(data, at)
            end = close.start() if close else len(data)
            if end > at:
                element.add(Tree("raw_text", at, end))
            if close:
                last = element.add(Tree("end_tag", end, close.end()))
                last.add(Tree("tag_name", end + 2, end + 2 + len(name)))
            at = element.end = close.end() if close else len(data)
        elif name not in VOID:
            path.append((element, name))
        return at


register("html", HtmlGrammar())
