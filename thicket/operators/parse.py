"""Files to syntax-tree nodes. Parsing is one Arrow pass over the files without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from thicket import grammars, schema
from thicket.grammars.tree import rows

#: Files parsed between two output batches.
FILES = 64
#: Node rows of an output batch.
ROWS = 1 << 15


def spread(files: DataFrame) -> DataFrame:
    """Deal the rows of a few large input splits to all cores; inputs with as many splits as cores stay as they are."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def parse_files(files: DataFrame, kinds: set[str] | None = None, with_text: bool = True, with_path: bool = False, columns: list[str] | None = None, texts: list[str] | None = None) -> DataFrame:
    """Nodes (schema.NODES, and ``path`` if asked for) of files with file_id, path, language and content.

    ``kinds``, ``with_text``, ``columns`` (of the node columns, in order) and
    ``texts`` (whole texts a node may have) push projection and selection into
    the parser, so other nodes and columns never leave it. Null content and
    unknown languages give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = columns or schema.NODES.fieldNames()
    out = T.StructType([*(schema.NODES[c] for c in names), *[T.StructField("path", T.StringType())] * with_path])
    every = schema.NODES.fieldNames()

    def run(batches):
        target = to_arrow_schema(out)
        wanted = pa.array(texts, pa.string()) if texts is not None else None

        def made(make, text, paths):
            found = [make[c]() for c in names] + [paths] * with_path
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, target, strict=True)], schema=target)
            return whole if wanted is None else whole.filter(pc.is_in(text, value_set=wanted))

        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                ids, paths = part.column(0).to_pylist(), part.column(1).to_pylist()
                languages, contents = part.column(2).to_pylist(), part.column(3).cast(pa.binary()).to_pylist()
                for language in sorted({x for x in languages if x}):
                    try:
                        grammar = grammars.get(language)
                    except schema.LanguageNotSupported:
                        continue
                    chosen = [i for i, x in enumerate(languages) if x == language and contents[i] is not None]
                    fast = [i for i in chosen if hasattr(grammar, "batches") and _valid(contents[i])]
                    if fast:
                        named = pa.array([paths[i] for i in fast], pa.string())
                        for doc, make in grammar.batches(np.array([ids[i] for i in fast], np.int64), [contents[i] for i in fast], kinds, with_text):
                            if wanted is not None:
                                text = make["text"]()
                                make["text"] = lambda text=text: text
                            yield made(make, text if wanted is not None else None, named.take(pa.array(doc)) if with_path else None)
                    found: list[tuple] = []
                    done = set(fast)
                    for i in chosen:
                        if i not in done:
                            found += [(ids[i], *row, paths[i]) for row in rows(grammar.parse(contents[i]), contents[i], kinds, with_text)]
                        if found and (len(found) >= ROWS or i == chosen[-1]):
                            lists = dict(zip([*every, "path"], zip(*found, strict=True), strict=True))
                            make = {f.name: lambda f=f: pa.array(lists[f.name], to_arrow_schema(T.StructType([f])).field(0).type) for f in schema.NODES}  # noqa: B023
                            yield made(make, make["text"](), pa.array(lists["path"], pa.string()))
                            found = []

    return spread(files.select("file_id", "path", "language", "content")).mapInArrow(run, out)


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True
