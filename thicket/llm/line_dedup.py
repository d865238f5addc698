"""Line dedup: delete later copies of repeated runs of lines.

A run counts if it holds ``min_words`` words or more. A line goes if it lies in a
run that counts and that occurs earlier, too. It suffices to look at the shortest
runs that count from each line on, and back from each line: any longer repeated
run is the union of such runs, so together they delete the maximal runs.

Method: a suffix array over the sequences of line ids, by distributed prefix
doubling. Ranks of runs of 1, 2, 4, ... lines come from sorting the distinct pairs
of ranks of their halves; the sort deals pairs to ranges, and a pair's place is
its rank. A run of any length m is told by the ranks of its two overlapping
halves of the largest power of two up to m: equal pairs are an interval of the
suffix array whose common prefix is m lines or more. Each interval's least
position is a partial aggregate, and the runs at other positions are deleted.
Suffixes that no longer share their rank with another, or that belong to no run
still to be decided, leave the sort.

Defined results: null text is empty; lines end with U+000A only, and compare byte
by byte; words are runs other than U+0020 and U+0009 to U+000D. Order of
documents: id, null ids last, then a hash of the text. Rows equal in id and text
are one document and are changed alike. ``dedupe`` keeps all columns and the
number of rows; a text that loses all lines is empty. An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.llm.lineage import cut

MIN_WORDS = 1
#: Intervals with more than one in so many rows are joined by broadcast; there can't be as many of them.
HOT = 1000

#: A document: its id (null: the largest long) and a hash of its text.
_KEY = ["d", "th"]
_LINES = "d long, th long, pos int, a long, b long, left int, right int"


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines of the shortest run with enough words that starts, and that ends, with it; 0: none."""
    sums = np.r_[0, np.cumsum(words)]
    n = len(words)
    end = np.searchsorted(sums, sums[:-1] + least, "left")
    start = np.searchsorted(sums, sums[1:] - least, "right") - 1
    left = np.where(end <= n, end - np.arange(n), 0)
    right = np.where(sums[1:] >= least, np.arange(n) + 1 - start, 0)
    return left, right


def _lines(least: int):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for doc, th, text in zip(ids, hashes, batch.column(2).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                left, right = shortest_runs(np.array([len(x.split()) for x in lines]), least)
                pairs = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), "<i8").reshape(-1, 2)
                for column, values in zip(out, ([doc] * len(lines), [th] * len(lines), range(len(lines)), pairs[:, 0], pairs[:, 1], left, right), strict=True):
                    column.extend(values)
                if len(out[0]) > 1 << 16:
                    yield _batch(out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield _batch(out)

    return run


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "th", "pos", "a", "b", "left", "right"])


def _ranked(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), their place in sorted order as r, and how many there are as n."""
    return cut(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("r"), "n"))


def _later(runs: DataFrame, place: Column) -> DataFrame:
    """The runs of an interval (m, a, b) of the suffix array but the one at the least place.

    A run that a large part of all lines hold isn't dealt by its key: there are less
    than ``HOT`` intervals with more than one in ``HOT`` of the rows, so their least
    places are sent to all tasks. The others are joined by key.
    """
    key = ["m", "a", "b"]
    first = cut(runs.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("held")).filter("held > 1"))
    total = runs.count()
    hot, rest = first.filter(F.col("held") * HOT > total).drop("held"), first.filter(F.col("held") * HOT <= total).drop("held")
    found = runs.join(F.broadcast(hot), key).unionByName(runs.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key))
    return found.filter(place > F.col("first")).select(*_KEY, "s", "m")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, th, s, m): runs of m lines from line s on that occur earlier; ``docs`` has d, th and text."""
    lines = cut(docs.select(*_KEY, "text").mapInArrow(_lines(min_words), _LINES).repartition(*_KEY).dropDuplicates([*_KEY, "pos"]))
    at_left = lines.filter("left > 0").select(*_KEY, F.col("pos").alias("s"), F.col("left").alias("m"))
    at_right = lines.filter("right > 0").select(*_KEY, (F.col("pos") + 1 - F.col("right")).alias("s"), F.col("right").alias("m"))
    runs = at_left.union(at_right).distinct()
    pairs, width, late = lines.select(*_KEY, "pos", "a", "b"), 1, None
    place = F.struct(*_KEY, "s")
    while True:
        # ranks of runs of ``width`` lines; a suffix that shares its rank with no other is out
        ranks = _ranked(pairs.select("a", "b"))
        suffixes = cut(pairs.join(ranks, ["a", "b"]).filter("n > 1").select(*_KEY, F.col("pos").alias("s"), "r"))
        decided = runs.filter(F.col("m").between(width, 2 * width - 1))
        heads = decided.join(suffixes, [*_KEY, "s"]).select(*_KEY, "s", "m", F.col("r").alias("a"), (F.col("s") + F.col("m") - width).alias("last"))
        both = heads.join(suffixes.select(*_KEY, F.col("s").alias("last"), F.col("r").alias("b")), [*_KEY, "last"])
        found = cut(_later(cut(both), place))
        late = found if late is None else late.union(found)
        runs = cut(runs.filter(F.col("m") >= 2 * width).join(suffixes, [*_KEY, "s"], "left_semi"))
        if runs.isEmpty():
            return late
        second = suffixes.select(*_KEY, (F.col("s") - width).alias("s"), F.col("r").alias("b"))
        joined = suffixes.withColumnRenamed("r", "a").join(second, [*_KEY, "s"]).join(runs.select(*_KEY).distinct(), _KEY, "left_semi")
        pairs, width = joined.select(*_KEY, F.col("s").alias("pos"), "a", "b"), 2 * width


def dedupe(frame: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """All columns, with the text of kept lines, and numbers of lines and of removed lines. A null text stays null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    d, th = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    late = repeated_runs(frame.select(d.alias("d"), th.alias("th"), F.col(text).alias("text")), min_words)
    gone = late.groupBy(*_KEY).agg(F.collect_list(F.struct("s", "m")).alias("gone")).select(F.col("d").alias("__d"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    kept = [c for c in frame.columns if c not in (n_lines, n_removed)]
    joined = frame.select(*kept, d.alias("__id"), th.alias("__hash")).join(gone, (F.col("__id") == F.col("__d")) & (F.col("__hash") == F.col("__th")), "left").drop("__id", "__hash", "__d", "__th")
    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(n_lines, T.LongType()), T.StructField(n_removed, T.LongType())])

    def run(batches):
        target = to_arrow_schema(schema)
        for batch in batches:
            texts, totals, removed = [], [], []
            for x, runs in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index("__gone")).to_pylist(), strict=True):
                lines = (x or "").split("\n")
                out = {i for r in runs or () for i in range(r["s"], r["s"] + r["m"])}
                texts.append("\n".join(line for i, line in enumerate(lines) if i not in out) if out else x)
                totals.append(len(lines))
                removed.append(len(out))
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*(c.cast(target.field(i).type) for i, c in enumerate(columns)), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], schema=target)

    return joined.mapInArrow(run, schema)
