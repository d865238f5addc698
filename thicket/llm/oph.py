"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

Every shingle of ``WORDS`` words is hashed once. The hash's leading bits name one
of ``BINS`` bins and the rest is its value; a bin keeps its least value. A hash
array is sorted once, together with a largest value of every bin, so the bins'
minima stand in bin order after one filter. Empty bins are filled by optimal
densification: bin b tries bins (a_b t + c_b) mod BINS for t = 0, 1, ... with an
odd a_b, which is a 2-universal choice that visits every bin, and takes the value
of the first that isn't empty, so any two documents make the same choices. Of
each value ``BITS`` low-order bits are kept, two hexadecimal digits a bin. The
likeness of two fingerprints is the share of equal bins, corrected for bins that
agree by chance.

Defined results: null text is empty; texts without words have the fingerprint of
an empty set, all bins zero, and are alike; texts with fewer words than a shingle
are one shingle; repeated rows and equal texts get equal fingerprints. Words are
maximal runs other than U+0020 and U+0009 to U+000D, compared without regard to
the case of A-Z. An empty table gives an empty table. ``edited_pairs`` returns
the columns it names only, so extra columns don't clash there; see it for ties
and null ids.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.lineage import cut

WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
_VALUE = 63 - BIN_BITS
_LARGEST = (1 << _VALUE) - 1
#: Stands for a null id while rows are matched.
_NONE = -(1 << 63)
#: Bins tried before the whole order is.
_TRIES = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _with_bins(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Add the kept bits of all bins, array<tinyint>. Each step is a column of its own, so no step is computed again for each element of the next."""
    names = [f"__{out}_{i}" for i in range(5)]
    words, hashes, every, least, full = (F.col(n) for n in names)
    split = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    limits = F.array(*(F.lit((b << _VALUE) | _LARGEST) for b in range(BINS)))
    draw = random.Random(1701)
    steps, shifts = (F.array(*(F.lit(draw.randrange(BINS) | odd) for _ in range(BINS))) for odd in (1, 0))
    shingle = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))), 1)
    n = F.size(words)
    value = lambda x: F.when(x.bitwiseAND(F.lit(_LARGEST)) != _LARGEST, x.bitwiseAND(F.lit((1 << BITS) - 1)))

    def tried(b, count):
        seen = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda t: F.get(full, (F.get(steps, b) * t + F.get(shifts, b)).bitwiseAND(F.lit(BINS - 1))))
        return F.get(F.filter(seen, lambda x: x.isNotNull()), F.lit(0))

    return (
        frame.withColumn(names[0], F.transform(split, lambda w: F.xxhash64(w)))
        .withColumn(names[1], F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), shingle)).when(n > 0, F.array(shingle(F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
        .withColumn(names[2], F.sort_array(F.concat(hashes, limits)))
        .withColumn(names[3], F.filter(every, lambda x, i: (i == 0) | (F.shiftright(x, _VALUE) != F.shiftright(F.get(every, i - 1), _VALUE))))
        .withColumn(names[4], F.transform(least, value))
        .withColumn(out, F.when(n > 0, F.transform(full, lambda x, b: F.coalesce(x, tried(b, _TRIES), tried(b, BINS)))).otherwise(F.array_repeat(F.lit(0).cast("bigint"), BINS)))
        .withColumn(out, F.transform(out, lambda x: (x - (1 << BITS - 1)).cast("tinyint")))
        .drop(*names)
    )


def packed(bins: Column) -> Column:
    """Hexadecimal digits of the bins' bits."""
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + (1 << BITS - 1))), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity (0 to 1) of the shingle sets behind two arrays of bins, corrected for the 2^-BITS of bins that agree by chance."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(a, i) == F.get(b, i))) / BINS
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def fingerprints(frame: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the packed fingerprint of every whole text; all other columns stay."""
    return _with_bins(frame, text, "__bins").withColumn(out, packed(F.col("__bins"))).drop("__bins")


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids in descending order; after the last comes the first.

    Ids are dealt to ranges; within one the next id is a window's, and the last id
    of a range takes the first of the next range, of which there are as many as
    shuffle partitions.
    """
    ranges = cut(ids.repartitionByRange(F.desc("doc_id")).select("doc_id", F.spark_partition_id().alias("part")))
    heads = ranges.groupBy("part").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.desc("head"))
    after = heads.select("part", F.coalesce(F.lead("head").over(order), F.max("head").over(Window.partitionBy())).alias("after"))
    within = ranges.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    return within.join(F.broadcast(after), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def edited_pairs(frame: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, and of it with its last third replaced by the beginning of the next document.

    Columns: doc_id, n_chars, edited (text), bins, edited_bins, next_bins (arrays
    as ``likeness`` takes them). The next document is that of the next smaller id;
    after the last comes the first, and null ids come last. Of rows that share an
    id, all have the same next id, and the one with the greatest beginning stands
    for the id where it is next. Without any id a text is its own next.
    """
    docs = frame.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    light = docs.select("doc_id", F.floor(F.char_length("text") / 3).cast("int").alias("k")).distinct()
    follows = next_ids(docs.select("doc_id").filter("doc_id is not null").distinct())
    first = docs.agg(F.max("doc_id").alias("first_id"))
    asked = light.join(follows, "doc_id", "left").crossJoin(F.broadcast(first)).select(F.col("doc_id").alias("asker"), F.col("k").alias("asked"), F.coalesce("next_id", "first_id").alias("next_id"))
    # both uses of the whole texts ask for the same columns by a key that is never null, so they share one exchange
    key = F.coalesce("doc_id", F.lit(_NONE))
    whole = _with_bins(docs, "text", "bins").select(key.alias("d"), "text", "bins").repartition("d")
    given = whole.join(asked.hint("shuffle_hash"), F.col("d") == F.col("next_id")).select(F.coalesce("asker", F.lit(_NONE)).alias("asker"), F.struct("asked", F.expr("substring(text, 1, asked)").alias("begin"), F.col("bins")).alias("given"))
    given = given.groupBy("asker").agg(F.collect_list("given").alias("given"))
    chars, third = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    # rows of one id ask for as many beginnings as they have lengths, so one for a proper key
    both = whole.join(given, F.col("d") == F.col("asker"), "left").withColumn("third", third).withColumn("given", F.array_max(F.filter("given", lambda g: g["asked"] == F.col("third"))))
    edited = F.concat(F.substring("text", F.lit(1), chars - third), F.coalesce("given.begin", F.substring("text", F.lit(1), third)))
    both = both.select(F.when(F.col("d") != _NONE, F.col("d")).alias("doc_id"), chars.alias("n_chars"), edited.alias("edited"), "bins", F.coalesce("given.bins", "bins").alias("next_bins"))
    return _with_bins(both, "edited", "edited_bins")
