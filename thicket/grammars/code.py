"""Tolerant grammars of seven programming languages: declarations, parameters, blocks, strings, comments and calls.

They aren't full grammars. A file is cut into tokens, brackets are nested, and
declarations are told by their leading keywords or shape; whatever isn't known
stays as tokens in place, so no file fails to parse. Anonymous tokens are kept as
children. The README lists the node kinds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from dataclasses import field as made

from thicket.grammars import register
from thicket.grammars.tree import Tree

_OPEN = {"(": ")", "[": "]", "{": "}"}
#: Brackets inside each other that make groups.
DEPTH = 100


@dataclass
class Language:
    """What tells one language from another; kinds are those of the public grammars."""

    name: str
    root: str
    line_comment: str
    comment: str = "comment"
    block_comment: str | None = r"/\*.*?(?:\*/|\Z)"
    string: str = "string_literal"
    strings: str = r'"(?:\\.|[^"\\\n])*"?'
    char: str | None = None
    # keyword: (node kind, kind of the name)
    declared: dict[str, tuple[str, str]] = made(default_factory=dict)
    parameters: str = "parameters"
    block: str = "block"
    body: str = "declaration_list"
    named_words: frozenset[str] = frozenset()
    symbols: list[tuple[str, str]] = made(default_factory=list)


class CodeGrammar:
    def __init__(self, language: Language) -> None:
        self.language = language
        lang = language
        parts = [rf"(?P<comment>{'|'.join(x for x in (lang.line_comment, lang.block_comment) if x)})", rf"(?P<string>{lang.strings})"]
        if lang.char:
            parts.append(rf"(?P<char>{lang.char})")
        parts += [r"(?P<word>[^\W\d]\w*)", r"(?P<number>\d[\w.]*)", r"(?P<mark>=>|->|::|:=|==|&&|\|\||[^\s\w])"]
        self.lexer = re.compile("|".join(parts), re.S | re.M)
        extra = {"identifier", "type_identifier", "field_identifier", "number", "ERROR", lang.root, lang.comment, lang.string, lang.parameters, lang.block, lang.body, "char_literal", *lang.named_words}
        extra |= {k for pair in lang.declared.values() for k in pair}
        self.kinds = frozenset(extra | _MORE[lang.name])
        self.fields = frozenset({"name", "parameters", "body", "trait", "type", "declarator", "path", "source", "module_name", "argument", "pattern", "receiver", "value"})
        self.anonymous = _Anything()
        self.symbols = lang.symbols

    def parse(self, data: bytes) -> Tree:
        text = data.decode("utf-8", "replace")
        size = [len(c.encode()) for c in text] if not text.isascii() else None
        at = [0]
        if size:
            for n in size:
                at.append(at[-1] + n)
        offset = (lambda i: at[i]) if size else (lambda i: i)
        tokens = []
        for m in self.lexer.finditer(text):
            kind, value = m.lastgroup, m[0]
            node = Tree("", offset(m.start()), offset(m.end()))
            if kind == "comment":
                node.kind = self.language.comment
            elif kind == "string":
                node.kind = self.language.string
            elif kind == "char":
                node.kind = "char_literal"
            elif kind == "number":
                node.kind = "number"
            elif kind == "word" and (value in self.language.named_words or not (value in self.language.declared or value in _WORDS)):
                node.kind = value if value in self.language.named_words else "identifier"
            else:
                node.kind, node.named = value, False
            tokens.append((value, node, m.start()))
        self.text = text
        items, _ = self._nest(tokens, 0, None)
        root = Tree(self.language.root, 0, len(data))
        root.children = self._python(items) if self.language.name == "python" else self._level(items, True)
        return root

    def _nest(self, tokens, i, closing):
        """Items: (value, node, ...) of a token, or of a bracket with its inner items. Open brackets wait on a stack, so depth doesn't matter here."""
        out: list[tuple] = []
        waiting: list[tuple] = []  # the items around a bracket, and the bracket
        flat: list[str] = []
        while i < len(tokens):
            value, node, start = tokens[i]
            if flat and not node.named and (value == flat[-1] or value in _OPEN):
                # brackets inside too many others stay plain tokens
                if value == flat[-1]:
                    flat.pop()
                else:
                    flat.append(_OPEN[value])
                out.append((value, node, None, start, None, None))
            elif not node.named and value in _OPEN and len(waiting) == DEPTH:
                flat.append(_OPEN[value])
                out.append((value, node, None, start, None, None))
            elif not node.named and value in _OPEN:
                waiting.append((out, value, node, start, closing))
                out, closing = [], _OPEN[value]
            elif not node.named and value == closing:
                if not waiting:
                    return out, i
                inner = out
                out, value, first, start, closing = waiting.pop()
                group = Tree(self.language.block if value == "{" else "bracketed", first.start, node.end)
                out.append((value, group, inner, start, first, node))
            else:
                out.append((value, node, None, start, None, None))
            i += 1
        while waiting:
            inner = out
            out, value, first, start, closing = waiting.pop()
            group = Tree(self.language.block if value == "{" else "bracketed", first.start, tokens[-1][1].end, error=True)
            out.append((value, group, inner, start, first, None))
        return out, i

    def _group(self, item, kind: str, top: bool = False) -> Tree:
        _, node, inner, _, first, last = item
        node.kind = kind
        node.children = [first, *(self._parameters(inner) if kind == self.language.parameters else self._level(inner, top)), *([last] if last else [])]
        return node

    def _parameters(self, items) -> list[Tree]:
        out, part = [], []
        for item in [*items, None]:
            if item is None or item[0] == "," and item[2] is None:
                words = [x for x in part if x[1].kind == "identifier"]
                if self.language.name in ("rust", "go", "c", "cpp") and len(words) > 1 and part:
                    held = Tree({"rust": "parameter", "go": "parameter_declaration"}.get(self.language.name, "parameter_declaration"), part[0][1].start, part[-1][1].end)
                    first = words[0][1] if self.language.name in ("rust", "go") else words[-1][1]
                    first.field = {"rust": "pattern", "go": "name"}.get(self.language.name, "declarator")
                    held.children = [x[1] for x in part]
                    out.append(held)
                else:
                    out += [x[1] for x in part]
                if item is not None:
                    out.append(item[1])
                part = []
            else:
                part.append(item)
        return out

    def _level(self, items, top: bool) -> list[Tree]:
        out, i = [], 0
        while i < len(items):
            node, i = self._one(items, i, top)
            out.append(node)
        return out

    def _one(self, items, i, top):
        lang, value, node = self.language, items[i][0], items[i][1]
        at = lambda k: items[k][0] if k < len(items) else ""
        if items[i][2] is not None:
            if value == "(" and at(i + 1) == "=>" and lang.name in ("js", "ts"):
                return self._arrow(items, i)
            return self._group(items[i], lang.block if value == "{" else "bracketed"), i + 1
        if value == "impl" and lang.name == "rust" or value in lang.declared and items[i][1].named is False:
            found = self._declaration(items, i, top)
            if found:
                return found
        if value == "import" and lang.name in ("js", "ts", "go"):
            return self._import(items, i)
        if value == "#" and lang.name in ("c", "cpp") and at(i + 1) == "include":
            return self._include(items, i)
        if lang.name in ("c", "cpp") and node.named and node.kind == "identifier" and at(i + 1) == "(":
            k = i + 2
            while at(k) in ("const", "override", "noexcept"):
                k += 1
            if at(k) == "{":
                return self._c_function(items, i, k)
        return node, i + 1

    def _declaration(self, items, i, top):
        lang, word, first = self.language, items[i][0], items[i][1]
        at = lambda k: items[k][0] if k < len(items) else ""
        kind, name_kind = lang.declared[word]
        out, k = Tree(kind, first.start, first.end), i + 1
        out.add(first)
        if lang.name == "go" and word == "func" and at(k) == "(":
            out.kind, name_kind = "method_declaration", "field_identifier"
            out.add(self._group(items[k], lang.parameters), "receiver")
            k += 1
        if word == "impl":
            return self._impl(items, i)
        if word == "use":
            return self._until(items, i, out, ";", "argument", "use_argument")
        if word == "typedef":
            return self._typedef(items, i, out)
        if lang.name == "go" and word == "type":
            if k < len(items) and items[k][1].kind == "identifier":
                spec = out.add(Tree("type_spec", items[k][1].start, items[k][1].end))
                items[k][1].kind = "type_identifier"
                spec.add(items[k][1], "name")
                k += 1
                if at(k) in ("struct", "interface"):
                    inner = spec.add(Tree(f"{at(k)}_type", items[k][1].start, items[k][1].end), "type")
                    inner.add(items[k][1])
                    if at(k + 1) == "{":
                        inner.add(self._group(items[k + 1], "field_declaration_list"))
                        inner.end = items[k + 1][1].end
                        k += 1
                    k += 1
                    spec.end = inner.end
                out.end = spec.end
                return out, k
            return None
        if k >= len(items) or items[k][1].kind != "identifier":
            return None
        name = items[k][1]
        name.kind = name_kind
        out.add(name, "name")
        out.end, k = name.end, k + 1
        stop = lang.name in ("js", "ts", "go")
        while k < len(items):
            value, node, inner = items[k][:3]
            if inner is not None and value == "(" and not any(c.field == "parameters" for c in out.children) and out.kind not in ("struct_item", "enum_item"):
                out.add(self._group(items[k], lang.parameters), "parameters")
            elif inner is not None and value == "{":
                callable_ = "function" in out.kind or "method" in out.kind
                out.add(self._group(items[k], lang.block if callable_ else lang.body, not callable_), "body")
                out.end = node.end
                k += 1
                if lang.name in ("c", "cpp") and at(k) == ";":
                    pass
                return out, k
            elif value == ";" or stop and "\n" in self.text[items[k - 1][3] : items[k][3]] and out.kind not in ("class_declaration", "interface_declaration", "function_declaration", "method_declaration"):
                if value == ";" and (lang.name == "rust" or out.kind == "type_alias_declaration"):
                    out.add(node)
                    out.end = node.end
                    k += 1
                return out, k
            elif lang.name in ("c", "cpp") and value not in (":", ",", "public", "private", "protected", "virtual", "<", ">", "::") and items[k][1].kind != "identifier":
                return out, k
            else:
                out.add(self._group(items[k], "bracketed") if inner is not None else node)
            out.end, k = node.end, k + 1
        return out, k

    def _until(self, items, i, out, end, field, kind):
        k, parts = i + 1, []
        while k < len(items) and items[k][0] != end:
            parts.append(self._group(items[k], "use_list") if items[k][2] is not None else items[k][1])
            k += 1
        if parts:
            whole = Tree("scoped_identifier" if len(parts) > 1 else parts[0].kind, parts[0].start, parts[-1].end, children=parts if len(parts) > 1 else [])
            out.add(whole, field)
            out.end = whole.end
        if k < len(items):
            out.add(items[k][1])
            out.end = items[k][1].end
        return out, k + 1

    def _impl(self, items, i):
        out, k, parts = Tree("impl_item", items[i][1].start, items[i][1].end), i + 1, []
        out.add(items[i][1])

        def typed(field):
            if parts:
                whole = Tree("type_identifier" if len(parts) == 1 else "generic_type", parts[0].start, parts[-1].end, children=[] if len(parts) == 1 else list(parts))
                out.add(whole, field)
                parts.clear()

        while k < len(items) and not (items[k][2] is not None and items[k][0] == "{") and items[k][0] != ";":
            if items[k][0] == "for":
                typed("trait")
                out.add(items[k][1])
            else:
                parts.append(items[k][1])
            k += 1
        typed("type")
        if k < len(items):
            out.add(self._group(items[k], self.language.body, True) if items[k][2] is not None else items[k][1], "body")
            out.end = items[k][1].end
        return out, k + 1

    def _typedef(self, items, i, out):
        k = i + 1
        while k < len(items) and items[k][0] != ";":
            if items[k][0] in ("struct", "enum", "union") and not items[k][1].named:
                node, k = self._declaration(items, k, True) or (items[k][1], k + 1)
                out.add(node)
                continue
            out.add(self._group(items[k], "bracketed") if items[k][2] is not None else items[k][1])
            k += 1
        if out.children[-1].kind == "identifier":
            out.children[-1].kind, out.children[-1].field = "type_identifier", "declarator"
        if k < len(items):
            out.add(items[k][1])
        out.end = out.children[-1].end
        return out, k + 1

    def _import(self, items, i):
        go = self.language.name == "go"
        out, k = Tree("import_declaration" if go else "import_statement", items[i][1].start, items[i][1].end), i + 1
        out.add(items[i][1])
        while k < len(items):
            value, node, inner = items[k][:3]
            if "\n" in self.text[items[k - 1][3] : items[k][3]] and inner is None and not (items[k - 1][0] in (",", "from")):
                break
            if node.kind == self.language.string:
                out.add(node, None if go else "source")
            else:
                group = self._group(items[k], "import_spec_list" if go else "named_imports") if inner is not None else node
                if go and inner is not None:
                    group.children = self._import_specs(group.children)
                out.add(group)
            out.end, k = node.end, k + 1
            if value == ";":
                break
        if go:
            out.children = self._import_specs(out.children)
        return out, k

    def _import_specs(self, nodes: list[Tree]) -> list[Tree]:
        """A list of imports, each with the name that may stand before its path."""
        out: list[Tree] = []
        for node in nodes:
            if node.kind == self.language.string:
                named = bool(out) and (out[-1].kind in ("identifier", "."))
                out.append(self._import_spec([out.pop(), node] if named else [node]))
            else:
                out.append(node)
        return out

    def _import_spec(self, nodes: list[Tree]) -> Tree:
        spec = Tree("import_spec", nodes[0].start, nodes[-1].end)
        for node, field in zip(reversed(nodes), ("path", "name")):
            node.field = field
        spec.children = nodes
        return spec

    def _include(self, items, i):
        line_end = self.text.find("\n", items[i][3])
        line_end = len(self.text) if line_end < 0 else line_end
        k = i
        while k < len(items) and items[k][3] < line_end:
            k += 1
        parts = [x[1] for x in items[i + 2 : k]]
        out = Tree("preproc_include", items[i][1].start, items[k - 1][1].end)
        out.add(Tree("#include", items[i][1].start, items[i + 1][1].end, False))
        if parts:
            out.add(Tree("system_lib_string" if len(parts) > 1 else parts[0].kind, parts[0].start, parts[-1].end), "path")
        return out, k

    def _c_function(self, items, i, body):
        start = items[i][1].start
        out = Tree("function_definition", start, items[body][1].end)
        declarator = out.add(Tree("function_declarator", start, items[i + 1][1].end), "declarator")
        declarator.add(items[i][1], "declarator")
        declarator.add(self._group(items[i + 1], "parameter_list"), "parameters")
        for k in range(i + 2, body):
            out.add(items[k][1])
        out.add(self._group(items[body], self.language.block), "body")
        return out, body + 1

    def _arrow(self, items, i):
        out = Tree("arrow_function", items[i][1].start, items[i + 1][1].end)
        out.add(self._group(items[i], self.language.parameters), "parameters")
        out.add(items[i + 1][1])
        k = i + 2
        if k < len(items):
            node, k = self._one(items, k, False)
            out.add(node, "body")
            out.end = node.end
        return out, k

    # Python: blocks by indentation

    def _python(self, items) -> list[Tree]:
        lines, current = [], []
        for item in items:
            if current and "\n" in self.text[current[-1][3] : item[3]] and "\n" in self.text[self.text.find("\n", current[-1][3]) : item[3]] and self._new_line(current[-1], item):
                lines.append(current)
                current = []
            current.append(item)
        if current:
            lines.append(current)
        indented = [(line[0][3] - (self.text.rfind("\n", 0, line[0][3]) + 1), line) for line in lines]
        out, _ = self._suite(indented, 0, -1)
        return out

    def _new_line(self, before, item) -> bool:
        # the group or string before may itself hold line ends
        start = before[3]
        length = len(self.text[start:].encode()[: before[1].end - before[1].start].decode("utf-8", "ignore"))
        return "\n" in self.text[start + length : item[3]]

    def _suite(self, lines, i, depth):
        out = []
        while i < len(lines) and lines[i][0] > depth:
            indent, line = lines[i]
            words = [x[0] for x in line]
            i += 1
            skip = 1 if words[0] == "async" else 0
            if words[skip] in ("def", "class") and len(line) > skip + 1 and not line[skip][1].named:
                node = Tree("function_definition" if words[skip] == "def" else "class_definition", line[0][1].start, line[-1][1].end)
                for x in line[: skip + 1]:
                    node.add(x[1])
                node.add(line[skip + 1][1], "name")
                colon = len(line)
                for k in range(skip + 2, len(line)):
                    if line[k][0] == "(" and line[k][2] is not None and not any(c.field == "parameters" for c in node.children):
                        node.add(self._group(line[k], self.language.parameters if words[skip] == "def" else "argument_list"), "parameters" if words[skip] == "def" else None)
                        continue
                    node.add(self._group(line[k], "bracketed") if line[k][2] is not None else line[k][1])
                    if line[k][0] == ":":
                        colon = k
                        break
                rest = self._level(line[colon + 1 :], False)
                inner, i = self._suite(lines, i, indent)
                if rest or inner:
                    body = node.add(Tree("block", (rest or inner)[0].start, (inner or rest)[-1].end, children=[*rest, *inner]), "body")
                    node.end = body.end
                out.append(node)
            elif words[0] in ("import", "from") and not line[0][1].named:
                node = Tree("import_statement" if words[0] == "import" else "import_from_statement", line[0][1].start, line[-1][1].end)
                node.add(line[0][1])
                k, first = 1, True
                while k < len(line):
                    if line[k][1].kind == "identifier" or line[k][0] == ".":
                        j = k
                        while j + 1 < len(line) and (line[j + 1][0] == "." or line[j][0] == "." and line[j + 1][1].kind == "identifier"):
                            j += 1
                        name = node.add(Tree("dotted_name", line[k][1].start, line[j][1].end, children=[x[1] for x in line[k : j + 1]]), "module_name" if words[0] == "from" and first else "name")
                        del name
                        first, k = False, j + 1
                    else:
                        node.add(self._group(line[k], "bracketed") if line[k][2] is not None else line[k][1])
                        k += 1
                out.append(node)
            else:
                out += self._level(line, False)
                inner, i = self._suite(lines, i, indent)
                out += inner
        return out, i


class _Anything:
    """Any anonymous token may be asked for; those that don't occur find nothing."""

    def __contains__(self, token: str) -> bool:
        return True


# Keywords that are anonymous tokens in all of these languages.
_WORDS = frozenset("as async await break case const continue default do else enum export extends for from func if impl import in include interface let new package private protected pub public return static struct switch typedef union use var where while yield".split())
# Further node kinds by language.
_MORE = {
    "rust": {"impl_item", "scoped_identifier", "use_list", "parameter", "generic_type", "bracketed", "use_argument"},
    "python": {"block", "dotted_name", "import_statement", "import_from_statement", "argument_list", "bracketed", "function_definition", "class_definition"},
    "js": {"import_statement", "arrow_function", "named_imports", "bracketed"},
    "ts": {"import_statement", "arrow_function", "named_imports", "bracketed"},
    "go": {"method_declaration", "type_spec", "struct_type", "interface_type", "field_declaration_list", "import_declaration", "import_spec", "import_spec_list", "parameter_declaration", "bracketed"},
    "c": {"function_definition", "function_declarator", "parameter_list", "parameter_declaration", "preproc_include", "system_lib_string", "bracketed"},
    "cpp": {"function_definition", "function_declarator", "parameter_list", "parameter_declaration", "preproc_include", "system_lib_string", "bracketed"},
}

_SLASHES = r"//[^\n]*"
_JS = {"function": ("function_declaration", "identifier"), "class": ("class_declaration", "identifier")}
_TS = {"function": ("function_declaration", "identifier"), "class": ("class_declaration", "type_identifier"), "interface": ("interface_declaration", "type_identifier"), "type": ("type_alias_declaration", "type_identifier"), "enum": ("enum_declaration", "identifier")}
_C = {"struct": ("struct_specifier", "type_identifier"), "enum": ("enum_specifier", "type_identifier"), "union": ("union_specifier", "type_identifier"), "typedef": ("type_definition", "type_identifier")}
_JS_STRINGS = r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?"""

_C_SYMBOLS = [
    ("function", "(function_definition declarator: (function_declarator declarator: (identifier) @name) @sig)"),
    ("struct", "(struct_specifier name: (type_identifier) @name) @sig"),
    ("import", "(preproc_include path: (_) @name) @sig"),
    ("enum", "(enum_specifier name: (type_identifier) @name) @sig"),
]

for _language in (
    # The patterns in ``symbols`` and the node kinds.
    Language("rust", "source_file", _SLASHES, "line_comment", char=r"'(?:\\.|[^'\\])'", declared={"fn": ("function_item", "identifier"), "struct": ("struct_item", "type_identifier"), "enum": ("enum_item", "type_identifier"), "trait": ("trait_item", "type_identifier"), "type": ("type_item", "type_identifier"), "mod": ("mod_item", "identifier"), "use": ("use_declaration", "identifier"), "impl": ("impl_item", "type_identifier")},
             symbols=[("function", "(source_file (function_item name: (identifier) @name) @sig)"), ("struct", "(struct_item name: (type_identifier) @name) @sig"), ("typealias", "(type_item name: (type_identifier) @name) @sig"), ("import", "(use_declaration argument: (_) @name) @sig"), ("trait", "(trait_item name: (type_identifier) @name) @sig"), ("trait", "(impl_item trait: (_) @trait_name type: (_) @type_name) @sig"), ("enum", "(enum_item name: (type_identifier) @name) @sig")]),
    Language("python", "module", r"#[^\n]*", block_comment=None, string="string", strings=r'[rRbBfFuU]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)', declared={"def": ("function_definition", "identifier"), "class": ("class_definition", "identifier")},
             symbols=[("function", "(function_definition name: (identifier) @name) @sig"), ("class", "(class_definition name: (identifier) @name) @sig"), ("import", "(import_statement (dotted_name) @name) @sig"), ("import", "(import_from_statement module_name: (dotted_name) @name) @sig")]),
    Language("js", "program", _SLASHES, string="string", strings=_JS_STRINGS, declared=_JS, parameters="formal_parameters", block="statement_block", body="class_body",
             symbols=[("function", "(function_declaration name: (identifier) @name) @sig"), ("class", "(class_declaration name: (identifier) @name) @sig"), ("import", "(import_statement source: (string) @name) @sig")]),
    Language("ts", "program", _SLASHES, string="string", strings=_JS_STRINGS, declared=_TS, parameters="formal_parameters", block="statement_block", body="class_body",
             symbols=[("function", "(function_declaration name: (identifier) @name) @sig"), ("class", "(class_declaration name: (type_identifier) @name) @sig"), ("interface", "(interface_declaration name: (type_identifier) @name) @sig"), ("typealias", "(type_alias_declaration name: (type_identifier) @name) @sig"), ("import", "(import_statement source: (string) @name) @sig")]),
    Language("go", "source_file", _SLASHES, string="interpreted_string_literal", strings=r'"(?:\\.|[^"\\\n])*"?|`[^`]*`?', declared={"func": ("function_declaration", "identifier"), "type": ("type_declaration", "type_identifier")}, parameters="parameter_list",
             symbols=[("function", "(function_declaration name: (identifier) @name) @sig"), ("struct", "(type_declaration (type_spec name: (type_identifier) @name) @sig)"), ("import", "(import_declaration (import_spec path: (interpreted_string_literal) @name) @sig)")]),
    Language("c", "translation_unit", _SLASHES, char=r"'(?:\\.|[^'\\])'", declared=_C, parameters="parameter_list", block="compound_statement", body="field_declaration_list", symbols=[*_C_SYMBOLS, ("struct", "(type_definition declarator: (type_identifier) @name) @sig")]),
    Language("cpp", "translation_unit", _SLASHES, char=r"'(?:\\.|[^'\\])'", declared={**_C, "class": ("class_specifier", "type_identifier")}, parameters="parameter_list", block="compound_statement", body="field_declaration_list", named_words=frozenset({"virtual"}), symbols=[*_C_SYMBOLS, ("class", "(class_specifier name: (type_identifier) @name) @sig")]),
):
    register(_language.name, CodeGrammar(_language))
