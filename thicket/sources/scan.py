"""Directories as file tables: ignore rules, excluded folders, languages and the binary test.

Names are listed on the driver, as hidden files and ignore files need a walk;
contents are read by the executors from the listed paths.
"""

from __future__ import annotations

import os
import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions by language, and folders that are never entered.
EXTENSIONS = {
    "rust": ["rs"],
    "python": ["py", "pyi"],
    "js": ["js", "mjs", "cjs"],
    "ts": ["ts", "mts", "cts", "tsx"],
    "go": ["go"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "hpp", "hxx", "cxx", "h"],
}
EXCLUDED = [".git", ".hg", ".svn", "target", "node_modules", ".tox", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", ".idea", ".vscode"]

#: Leading bytes that the binary test looks at.
SNIFF = 8192


def language_of(path: Column) -> Column:
    """Language by extension in any case, null for others; ``.h`` is C."""
    found = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for language, extensions in reversed(EXTENSIONS.items()):
        out = F.when(found.isin(extensions), F.lit(language)).otherwise(out)
    return out


def in_excluded(path: Column) -> Column:
    """Whether a folder of the relative path is one that isn't entered; a file of that name is fine."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: d.isin(EXCLUDED))


def is_binary(content: Column) -> Column:
    """A zero byte in the first 8192 bytes, or bytes there that aren't UTF-8; an empty file isn't binary."""
    head = F.substring(content, 1, SNIFF)
    return F.contains(head, F.lit(bytearray(b"\0"))) | ~F.is_valid_utf8(head)


class Ignore:
    """The rules of one ignore file, relative to its folder."""

    def __init__(self, base: str, text: str) -> None:
        self.base, self.rules = base, []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:]
            only_folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._regex(line.lstrip("/")) + r"\Z", re.S), keep, only_folder))

    @staticmethod
    def _regex(glob: str) -> str:
        out, at = "", 0
        while at < len(glob):
            if glob.startswith("**/", at):
                out, at = out + "(?:.*/)?", at + 3
            elif glob.startswith("**", at):
                out, at = out + ".*", at + 2
            elif glob[at] == "*":
                out, at = out + "[^/]*", at + 1
            elif glob[at] == "?":
                out, at = out + "[^/]", at + 1
            elif glob[at] == "[" and "]" in glob[at + 2 :]:
                end = glob.index("]", at + 2)
                out, at = out + "[" + glob[at + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, at = out + re.escape(glob[at]), at + 1
        return out

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True: ignored; False: kept against earlier rules; None: no rule matches."""
        inner, found = os.path.relpath(path, self.base), None
        for regex, keep, only_folder in self.rules:
            if regex.match(inner) and (folder or not only_folder):
                found = not keep
        return found


def listing(root: str) -> list[tuple[str, int, int]]:
    """(path relative to root, bytes, modification second) of files that a search looks at. Links aren't followed; what can't be read is left out with a warning."""
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    in_repository = any(os.path.isdir(os.path.join(p, ".git")) for p in _upward(root))
    out: list[tuple[str, int, int]] = []
    skipped: list[tuple[str, str]] = []

    def visit(folder: str, rules: list[Ignore]) -> None:
        own = list(rules)
        for name in ([".gitignore"] if in_repository else []) + [".ignore"]:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    own.append(Ignore(folder, f.read()))
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            skipped.append((os.path.relpath(folder, root), str(e)))
            return
        for entry in entries:
            if entry.is_symlink():
                continue
            is_folder = entry.is_dir()
            verdicts = [v for v in (r.verdict(entry.path, is_folder) for r in own) if v is not None]
            if verdicts and verdicts[-1] or is_folder and entry.name in EXCLUDED:
                continue
            if is_folder:
                visit(entry.path, own)
            else:
                try:
                    stat = entry.stat()
                except OSError as e:
                    skipped.append((os.path.relpath(entry.path, root), str(e)))
                    continue
                out.append((os.path.relpath(entry.path, root), stat.st_size, int(stat.st_mtime)))

    visit(root, _outer_rules(root))
    for path, error in skipped:
        warnings.warn(f"skipped {path}: {error}", stacklevel=2)
    return out


def _outer_rules(root: str) -> list[Ignore]:
    """Rules that hold below ``root`` though they stand elsewhere, weakest first: those of the repository's own exclude file, and of the folders from the repository's top down to the parent of ``root``; ``.ignore`` files count in every parent folder."""
    parents = list(_upward(root))
    top = next((i for i, p in enumerate(parents) if os.path.isdir(os.path.join(p, ".git"))), None)
    files = [] if top is None else [(parents[top], os.path.join(parents[top], ".git", "info", "exclude"))]
    for i in range(len(parents) - 1, 0, -1):
        names = ([".gitignore"] if top is not None and i <= top else []) + [".ignore"]
        files += [(parents[i], os.path.join(parents[i], name)) for name in names]
    rules = []
    for base, path in files:
        if os.path.isfile(path):
            try:
                with open(path, encoding="utf-8", errors="replace") as f:
                    rules.append(Ignore(base, f.read()))
            except OSError as e:
                warnings.warn(f"skipped {path}: {e}", stacklevel=3)
    return rules


def _upward(path: str):
    while True:
        yield path
        up = os.path.dirname(path)
        if up == path:
            return
        path = up


def scan(spark: SparkSession, root: str, lang: str = "auto") -> DataFrame:
    """schema.FILES and ``error`` (null: fine) of the files of one language, or of all known ones."""
    if lang != "auto" and lang not in EXTENSIONS:
        raise ValueError(f"unknown language {lang}")
    root = os.path.realpath(root)
    names = spark.createDataFrame(listing(root) or [], "path string, file_size_bytes long, mtime_secs long")
    if lang == "auto":
        named = names.withColumn("language", language_of(F.col("path"))).filter("language is not null")
    else:
        named = names.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(EXTENSIONS[lang])).withColumn("language", F.lit(lang))
    ids = named.withColumn("file_id", F.xxhash64("path"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                contents, errors = [], []
                for path in part.column("path").to_pylist():
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            contents.append(f.read())
                        errors.append(None if contents[-1] else "File is empty")
                    except OSError as e:
                        contents.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("file_id", "path", "language", "file_size_bytes", "mtime_secs")] + [pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["file_id", "path", "language", "file_size_bytes", "mtime_secs", "content", "error"])

    found = ids.mapInArrow(read, "file_id long, path string, language string, file_size_bytes long, mtime_secs long, content binary, error string")
    binary = F.when(F.col("error").isNull() & is_binary(F.col("content")), "binary file").otherwise(F.col("error"))
    return found.select("file_id", "path", "language", "content", "file_size_bytes", "mtime_secs", binary.alias("error"))
