"""Captures of the code and HTML grammars, with places, on small sources."""

import pytest

from thicket import grammars
from thicket.operators import matcher
from thicket.plans import sexpr


def found(language, source, query):
    data = source.encode()
    return [(r[7], r[0], r[1]) for r in matcher.match(sexpr.parse(query), grammars.get(language).parse(data), data)]


CASES = [
    ("rust", "fn alpha() {}\n\nfn beta(x: i32) -> i32 { x }\n", "(function_item name: (identifier) @f)", [("alpha", 1, 3), ("beta", 3, 3)]),
    ("rust", "mod a {\n    fn one() {}\n    mod b { fn two() {} }\n}\n", "(function_item name: (identifier) @f)", [("one", 2, 7), ("two", 3, 15)]),
    ("rust", "struct Point { x: f64 }\npub struct Unit;\n", "(struct_item name: (type_identifier) @s)", [("Point", 1, 7), ("Unit", 2, 11)]),
    ("rust", "use std::io;\n", "(use_declaration argument: (_) @u)", [("std::io", 1, 4)]),
    ("rust", 'fn grüßen() { let s = "ß"; }\nfn after() {}\n', "(function_item name: (identifier) @f)", [("grüßen", 1, 3), ("after", 2, 3)]),
    ("python", "def greet(name):\n    return name\n\n\ndef add(a, b):\n    def inner(c):\n        return c\n    return inner\n", "(function_definition name: (identifier) @f)", [("greet", 1, 4), ("add", 5, 4), ("inner", 6, 8)]),
    ("python", "class A(B):\n    def m(self): pass\nimport os.path\nfrom a.b import c\n", "(class_definition name: (identifier) @c)\n(import_from_statement module_name: (dotted_name) @m)", [("A", 1, 6), ("a.b", 4, 5)]),
    ("js", "function greet(n) { return n; }\nconst f = (a, b) => a + b;\nclass Animal { }\nimport x from 'y';\n", "(function_declaration name: (identifier) @f)\n(class_declaration name: (identifier) @c)\n(arrow_function parameters: (formal_parameters (identifier) @p))\n(import_statement source: (string) @s)", [("greet", 1, 9), ("a", 2, 11), ("b", 2, 14), ("Animal", 3, 6), ("'y'", 4, 14)]),
    ("ts", "interface IConfig { a: string }\nclass Dog { }\ntype Id = string;\nfunction go(): void { }\n", "(interface_declaration name: (type_identifier) @i)\n(class_declaration name: (type_identifier) @c)\n(type_alias_declaration name: (type_identifier) @t)", [("IConfig", 1, 10), ("Dog", 2, 6), ("Id", 3, 5)]),
    ("go", 'package main\n\nimport "fmt"\n\nfunc greet(n string) {\n}\n\ntype Point struct {\n\tX int\n}\n\nfunc (p Point) area() int {\n\treturn 1\n}\n', "(function_declaration name: (identifier) @f)\n(type_declaration (type_spec name: (type_identifier) @t))\n(import_declaration (import_spec path: (interpreted_string_literal) @i))\n(method_declaration name: (field_identifier) @m)", [('"fmt"', 3, 7), ("greet", 5, 5), ("Point", 8, 5), ("area", 12, 15)]),
    ("c", "#include <stdio.h>\n\nint add(int a, int b) {\n  return a + b;\n}\ntypedef struct {\n  int x;\n} Point;\n", "(function_definition declarator: (function_declarator declarator: (identifier) @f))\n(preproc_include path: (_) @i)\n(type_definition declarator: (type_identifier) @t)", [("<stdio.h>", 1, 9), ("add", 3, 4), ("Point", 8, 2)]),
    ("cpp", "class Animal {\npublic:\n  virtual void speak() { }\n};\nclass Dog : public Animal { };\n", "(class_specifier name: (type_identifier) @c)\n(virtual) @keyword", [("Animal", 1, 6), ("virtual", 3, 2), ("Dog", 5, 6)]),
    ("html", '<p class="x">Hi <a href="/u">there</a></p>', '(attribute (attribute_name) @n (quoted_attribute_value (attribute_value) @v) (#eq? @n "href"))', [("href", 1, 19), ("/u", 1, 25)]),
]


@pytest.mark.parametrize("language,source,query,want", CASES)
def test_captures(language, source, query, want):
    assert found(language, source, query) == want


def test_anonymous_tokens_and_broken_sources():
    assert found("rust", "fn a() {}", '("fn" @k)') == [("fn", 1, 0)]
    for language in grammars.names():
        for source in ("", "fn (", "{{{", "class", "def", "import", "'", "typedef struct", "type", "func (x", "# include"):
            grammars.get(language).parse(source.encode())
        for n in (99, 100, 101, 5000):
            for opened, closed in ("()", "{}", "[]"):
                grammars.get(language).parse((opened * n).encode())
                grammars.get(language).parse((opened * n + "x" + closed * n + " y").encode())
    assert found("rust", "mod a " + "{" * 3000 + "}" * 3000 + "\nfn after() {}", "(function_item name: (identifier) @f)") == [("after", 2, 3)]


def test_quantifiers_and_alternations():
    source = "a b c\nd\n"
    assert [x[0] for x in found("text", source, "(line (word)+ @w)")] == ["a", "b", "c", "d"]
    assert [x[0] for x in found("text", source, '[(line) (word)] @x (#any-of? @x "d" "a")')] == ["a", "d"]
    assert [x[0] for x in found("text", source, "(line . (word) @w (word)? @z)")] == ["a", "b", "c", "d"]
