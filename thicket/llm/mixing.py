"""Mixing sources to target weights, by temperature.

Source i has a share p_i of all tokens; its target weight is proportional to
p_i^a. The exponent a is bisected, so that the weights' entropy reaches a target,
or so that no source is repeated more often than a limit. The budget is the least
one under which every source is read once at least; a source's part of it is
then realised as whole *blocks*, each a permutation of all its documents, and a
last block that ends where the part is used up. Block e of a source orders its
documents by the MD5 of seed, source, block and id.

Places in a permutation and token sums are found from counts by leading digits of
the MD5, so the documents of one large source are spread over many groups. The
source table itself is looked at locally up to ``LOCAL`` sources, and by an
aggregate for each step of the bisection beyond.

Defined results: a null source is the source named by the empty string; a null
or blank text has no tokens; a source without tokens is read once; equal rows are
drawn each; rows of one id are ordered by tokens; a null id counts as the empty
string in the hash. An empty table gives an empty table. ``realise`` keeps all
columns and doesn't add any; rows that tie with the last drawn one come with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.lineage import cut

SEED = 42
STEPS = 60
LOCAL = 100_000
#: Documents of one source in a group of leading digits, on average.
GROUP = 20_000


def tokens_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(source: Column, block: Column, ident: Column) -> Column:
    """Hexadecimal digits by which a block orders its documents."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), source, block.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


@dataclass
class Shares:
    """Token sums of sources, kept apart: the driver sees them only where they are few."""

    table: DataFrame
    largest: int
    smallest: int
    total: int
    local: list[int] | None

    def entropy(self, a: float) -> float:
        """Of the weights p^a, in nats."""
        if self.local is not None:
            powers = [(t / self.total) ** a for t in self.local]
            z = sum(powers)
            return math.log(z) - a * sum(x * math.log(t / self.total) for x, t in zip(powers, self.local, strict=True)) / z
        p = F.col("tokens") / self.total
        z, s = self.table.filter("tokens > 0").agg(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))).first()
        return math.log(z) - a * s / z


def shares(docs: DataFrame) -> Shares:
    """From rows of source and tokens."""
    table = cut(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    n = table.count()  # all sources, as the whole table is sent to tasks where it's small
    some = table.filter("tokens > 0")
    largest, smallest, total = some.agg(F.max("tokens"), F.min("tokens"), F.sum("tokens")).first()
    return Shares(table, largest or 0, smallest or 0, total or 0, [r["tokens"] for r in some.select("tokens").collect()] if n <= LOCAL else None)


def exponent(found: Shares, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The least exponent from 0 to 1 under which no source is repeated more than ``max_repeats`` times; or the greatest whose weights have ``entropy``."""
    if not found.total or (max_repeats is None) == (entropy is None):
        if found.total:
            raise ValueError("give one of max_repeats and entropy")
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        if max_repeats is not None:
            # repeats of a source are as t^(a - 1), and 1 for the largest
            if math.pow(found.largest / found.smallest, 1.0 - mid) <= max_repeats:
                high = mid
            else:
                low = mid
        elif found.entropy(mid) >= entropy:
            low = mid
        else:
            high = mid
    return high if max_repeats is not None else low


def budgets(found: Shares, a: float) -> DataFrame:
    """(source, blocks, rest): whole blocks, and the tokens of the last one."""
    part = F.when(F.col("tokens") > 0, F.floor(F.pow(F.lit(float(found.largest)), F.lit(1.0 - a)) * F.pow(F.col("tokens").cast("double"), F.lit(a)) + 0.5).cast("long")).otherwise(F.col("tokens"))
    part = F.greatest(part, F.col("tokens"))
    blocks = F.when(F.col("tokens") > 0, F.floor(part / F.col("tokens")).cast("long")).otherwise(F.lit(1).cast("long"))
    return found.table.select("source", "docs", "tokens", part.alias("part"), blocks.alias("blocks")).select("source", "docs", "blocks", (F.col("part") - F.col("blocks") * F.col("tokens")).alias("rest"))


def _beside(found: Shares, table: DataFrame) -> DataFrame:
    """A table of sources, sent whole to all tasks where there are at most ``LOCAL``, so that a large source isn't dealt to one."""
    return F.broadcast(table) if found.local is not None else table


def _light(frame: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    return cut(frame.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), tokens_of(F.col(text)).alias("tokens")))


def draws(frame: DataFrame, max_repeats: float | None = None, entropy: float | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, block, place, tokens): every draw, with its place in its block's permutation, from 0."""
    docs = _light(frame, id_col, source, text)
    found = shares(docs)
    plan = budgets(found, exponent(found, max_repeats, entropy))
    most = found.table.agg(F.max("docs")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most / GROUP), 16)))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.when(F.col("rest") > 0, 0).otherwise(1))
    rows = docs.join(_beside(found, plan), "source").withColumn("block", F.explode(blocks)).withColumn("key", order_key(F.col("source"), F.col("block"), F.col("doc_id"))).withColumn("lead", F.substring("key", 1, digits))
    group = ["source", "block", "lead"]
    before = Window.partitionBy("source", "block").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group).agg(F.count("*").alias("c"), F.sum("tokens").alias("t")).select(*group, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    within = Window.partitionBy(*group).orderBy("key", "doc_id", "tokens")
    placed = rows.withColumn("i", F.row_number().over(within) - 1).withColumn("used", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).join(sums, group)
    kept = placed.filter((F.col("block") < F.col("blocks")) | (F.col("t0") + F.col("used") < F.col("rest")))
    return kept.select("doc_id", "source", "block", (F.col("c0") + F.col("i")).alias("place"), "tokens")


def realise(frame: DataFrame, max_repeats: float | None = None, entropy: float | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``frame``, each as often as it is drawn.

    The last block's documents are those up to the last drawn key, so rows are
    matched to their source's plan alone and whole texts aren't shuffled by key.
    """
    docs = _light(frame, id_col, source, text)
    found = shares(docs)
    plan = budgets(found, exponent(found, max_repeats, entropy))
    drawn = draws_of_last_block(docs, plan, found)
    whole = plan.join(drawn, "source", "left").select(F.col("source").alias("__source"), F.col("blocks").alias("__blocks"), F.col("upto").alias("__upto"))
    name, block = F.coalesce(F.col(source).cast("string"), F.lit("")), F.col("__blocks")
    place = F.struct(order_key(name, block, F.col(id_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), tokens_of(F.col(text)).alias("tokens"))
    times = (block + F.when(place <= F.col("__upto"), 1).otherwise(0)).cast("int")
    return frame.join(_beside(found, whole), name == F.col("__source")).withColumn("__again", F.explode(F.sequence(F.lit(1), times))).select(*(frame[c] for c in frame.columns))


def draws_of_last_block(docs: DataFrame, plan: DataFrame, found: Shares) -> DataFrame:
    """(source, upto): the last (key, doc_id, tokens) of each source's last block."""
    most = found.table.agg(F.max("docs")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most / GROUP), 16)))
    rows = docs.join(_beside(found, plan.filter("rest > 0")), "source").withColumn("key", order_key(F.col("source"), F.col("blocks"), F.col("doc_id"))).withColumn("lead", F.substring("key", 1, digits))
    group = ["source", "lead"]
    before = Window.partitionBy("source").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group).agg(F.sum("tokens").alias("t")).select(*group, F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    within = Window.partitionBy(*group).orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("used", F.sum("tokens").over(within) - F.col("tokens")).join(sums, group).filter(F.col("t0") + F.col("used") < F.col("rest"))
    return placed.groupBy("source").agg(F.max(F.struct("key", F.col("doc_id").cast("long").alias("doc_id"), "tokens")).alias("upto"))
