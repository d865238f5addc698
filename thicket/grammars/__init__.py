"""Grammars by language. A grammar turns bytes into a tree; ``register`` adds one."""

from __future__ import annotations

from thicket.schema import LanguageNotSupported

_GRAMMARS: dict[str, object] = {}


def register(name: str, grammar) -> None:
    """Make a grammar known: an object with ``kinds``, ``fields`` and ``parse(bytes) -> Tree``."""
    _GRAMMARS[name] = grammar


def get(name: str):
    _load()
    if name not in _GRAMMARS:
        raise LanguageNotSupported(name)
    return _GRAMMARS[name]


def names() -> list[str]:
    _load()
    return sorted(_GRAMMARS)


def _load() -> None:
    from thicket.grammars import code, html, text  # noqa: F401  each registers itself
