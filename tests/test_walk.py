"""Folders: rules from outside the searched folder, what can't be read, and imports in lists."""

import os

import pytest

from tests.test_grammars import found
from thicket.sources import scan


def test_rules_of_parents_and_of_the_repository(tmp_path):
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("secret.rs\n")
    (tmp_path / ".gitignore").write_text("*.py\n/top.go\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / ".ignore").write_text("!keep.py\nb/x.js\n")
    for name in ("secret.rs", "plain.rs", "drop.py", "keep.py", "top.go", "x.js"):
        (tmp_path / "a" / "b" / name).write_text("x")
    assert [x[0] for x in scan.listing(str(tmp_path / "a" / "b"))] == ["keep.py", "plain.rs", "top.go"]


def test_what_cant_be_listed_is_left_out(tmp_path, monkeypatch):
    (tmp_path / "good").mkdir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "good" / "x.rs").write_text("fn a() {}")
    listed = os.scandir

    def refuse(folder):
        if os.path.basename(folder) == "bad":
            raise PermissionError("no")
        return listed(folder)

    monkeypatch.setattr(os, "scandir", refuse)
    with pytest.warns(UserWarning, match="skipped bad: no"):
        assert [x[0] for x in scan.listing(str(tmp_path))] == ["good/x.rs"]


def test_go_imports_in_lists_and_with_names():
    source = 'package p\nimport (\n\t"os"\n\tf "fmt"\n\t_ "net"\n\t. "io"\n)\nimport g "log"\n'
    query = "(import_spec path: (interpreted_string_literal) @p)"
    assert [x[0] for x in found("go", source, query)] == ['"os"', '"fmt"', '"net"', '"io"', '"log"']
    assert [x[0] for x in found("go", source, "(import_spec) @s")] == ['"os"', 'f "fmt"', '_ "net"', '. "io"', 'g "log"']
