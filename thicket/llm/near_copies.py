"""One of each group of near copies: shingle sets with an exact Jaccard similarity of ``LIKE`` or more are linked.

A 64-bit SimHash can't hold that range in a small radius: at 0.8 two fingerprints
differ in about ten bits. So links within SimHash's radius are only one source of
candidates here. The other are bands of minimum hashes: ``BANDS`` keys of ``ROWS``
minima each; two sets of similarity s share a key with probability
1 - (1 - s^ROWS)^BANDS, which is 0.9996 at 0.8. Every candidate is confirmed by
the exact similarity of the whole sets, so no other pair is linked.

Documents with equal sets are one node. Sets that share a key are a bucket. First
every member is held against one set: of the least and greatest members of its
buckets that with which it shares most keys. That links up a large group of near
copies with one pair for each. Of buckets that are then still in several
components, a set goes if so many of its shingles are in no other such set that it
can't be alike to any of its bucket. The others are held against the most central
member of a bucket, the one with the least share of such shingles, and then, while
the pairs left are more than ``LEFT`` for each member and ``TURNS`` allows, against
that of another component. What is left then are pairs of a bucket in different
components; all of them are compared, each under one key, so no link is lost, but
those that can't be alike by their sizes and numbers of shingles of their own.

Defined results: null and blank texts have the empty set and are alike; texts
with fewer words than a shingle are one shingle; an empty table gives an empty
table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import simhash
from thicket.llm.components import components
from thicket.llm.lineage import cut

LIKE = 0.8
BANDS, ROWS = 20, 5
#: Pairs left for each member of a bucket that are compared outright, and how often central members are tried before.
LEFT, TURNS = 2, 2
#: Rows of keys that are broadcast at most.
FEW = 50_000
#: Shingle hashes multiplied together.
_HASHES = 1 << 12

_draw = random.Random(1847)
_FACTORS = np.array([_draw.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64)
_KEY = ["d", "th"]


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    return np.unique(simhash.shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The set's keys, one for each band; an empty set has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _HASHES):
        least = np.minimum(least, (hashes[None, at : at + _HASHES] * _FACTORS[:, None]).min(axis=1))
    return [xxhash.xxh3_64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            fps, nodes, sizes, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = simhash.shingle_hashes(text, words)
                fps.append(simhash.majority(hashes))
                hashes = np.unique(hashes)
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                keys.append(np.array(band_keys(hashes), np.uint64).view(np.int64))
            longs = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "fp", "node", "n", "keys"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(x, words).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return run


def _agree(like: float):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= like * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are alike."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(_agree(like), "a long, b long"))


def _pair(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _links(nodes: DataFrame, docs: DataFrame, frame: DataFrame, words: int, like: float) -> DataFrame:
    """Confirmed edges (a, b) that connect what is alike; ``frame`` has d, th and text."""
    fits = lambda m, n: F.least(m, n) >= like * F.greatest(m, n)
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    place = F.struct("n", "node")
    ends = members.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low.node <> high.node")
    members = cut(members.join(ends, "key"))
    stars = [members.select("key", "node", "n", F.col(f"{e}.node").alias("pivot"), F.col(f"{e}.n").alias("m")) for e in ("low", "high")]
    star = _best(stars[0].union(stars[1]).filter(fits(F.col("n"), F.col("m"))))
    members = members.select("key", "node", "n")

    # SimHash's links, between the least nodes of their fingerprints
    least = cut(docs.groupBy("fp").agg(F.min("node").alias("least")))
    near = simhash.links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")) for c in "ab")
    far = near.join(a, "a").join(b, "b").select(*_pair(F.col("node_a"), F.col("node_b")))
    same = docs.select("fp", "node").distinct().join(least, "fp").select(*_pair(F.col("node"), F.col("least")))
    pairs = cut(star.union(far).union(same).filter("a <> b").distinct())

    # whole sets of the nodes that can be compared at all, each from one row
    asked = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    source = cut(nodes.join(asked, "node").select("node", F.coalesce("first.doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("first.th").alias("th")))
    sets = cut(frame.join(_small(source), _KEY).select("node", "text").mapInArrow(_sets(words), "node long, hashes array<long>").dropDuplicates(["node"]))

    edges, done = _confirmed(pairs, sets, like), pairs
    members = _several(members, edges)
    # shingles that no other set in question has: with too many of them a set is alike to none
    asked = members.select("node").distinct()
    single = sets.join(asked, "node").select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("held"), F.min("node").alias("node")).filter("held = 1")
    single = single.groupBy("node").agg(F.count("*").alias("own"))
    members = members.drop("root").join(single, "node", "left").withColumn("held", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    # of a set of n with ``held`` shingles that others have, and one of m or more, at most ``held`` are in both
    least = members.groupBy("key").agg(F.min("n").alias("m"))
    able = F.col("held") >= like * (F.col("n") + F.greatest(F.col("m"), F.col("held")) - F.col("held"))
    members = _several(members.join(least, "key").filter(able).drop("m"), edges)
    for turn in range(TURNS):
        sizes = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"))
        left, total = sizes.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.sum("all")).first()
        if not total or left <= LEFT * total:
            break
        # the most central member of all first, then that of some component, drawn by a hash
        part = -F.col("held") / F.col("n")
        share = part if turn == 0 else F.xxhash64("root", F.lit(turn)).cast("double")
        central = members.groupBy("key").agg(F.min(F.struct(share.alias("share"), part.alias("part"), "n", "node", "root")).alias("c"))
        found = members.join(central, "key").filter((F.col("root") != F.col("c.root")) & fits(F.col("n"), F.col("c.n")))
        found = cut(_best(found.select("key", "node", F.col("c.node").alias("pivot"))).join(done, ["a", "b"], "left_anti").distinct())
        edges, done = edges.union(_confirmed(found, sets, like)), done.union(found)
        members = _several(members.drop("root"), edges)
    # a pair that shares several keys is made under the least of those that both still have
    here = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    members = cut(members.join(here, "node"))
    x, y = (members.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "held", "root", "keys"))) for s in "xy")
    both = F.least("held_x", "held_y")
    able = (F.col("root_x") < F.col("root_y")) & fits(F.col("n_x"), F.col("n_y")) & (both >= like * (F.col("n_x") + F.col("n_y") - both))
    once = F.col("key") == F.array_min(F.array_intersect("keys_x", "keys_y"))
    rest = x.join(y.withColumnRenamed("key", "key_y"), (F.col("key") == F.col("key_y")) & able & once)
    rest = rest.select(*_pair(F.col("node_x"), F.col("node_y")))
    return edges.union(_confirmed(rest.join(done, ["a", "b"], "left_anti"), sets, like))


def _best(stars: DataFrame) -> DataFrame:
    """For each node the pivot with which it shares most keys, as a pair."""
    shared = stars.filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("keys"))
    best = shared.groupBy("node").agg(F.max_by("pivot", F.struct("keys", -F.col("pivot"))).alias("pivot"))
    return best.select(*_pair(F.col("node"), F.col("pivot")))


def _small(keys: DataFrame) -> DataFrame:
    """Keys that are sent whole to all tasks if they are at most ``FEW``, so that texts aren't shuffled to meet them."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def _several(members: DataFrame, edges: DataFrame) -> DataFrame:
    """With the root of each node's component, the members of keys that are in several components."""
    named = members.join(components(edges).select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return cut(named.join(mixed, "key"))


def one_of_each(frame: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, like: float = LIKE) -> DataFrame:
    """The rows of ``frame`` without those whose group has one with a smaller id (null: after all others), or an equal id and a smaller hash of its text. All columns stay; rows equal in id and text become one."""
    body = F.col(text).cast("string")
    whole = frame.select(F.col(id_col).cast("long").alias("doc_id"), simhash.text_hash(body).alias("th"), body.alias("text"))
    docs = cut(whole.mapInArrow(_sketches(words), "doc_id long, th long, fp long, node long, n long, keys array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    # equal sets have equal keys
    nodes = cut(docs.groupBy("node").agg(first, F.min("n").alias("n"), F.min("keys").alias("keys")))
    keyed = whole.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "th", "text")
    roots = components(_links(nodes, docs, keyed, words, like)).select("node", "root")
    stay = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first.th")
    # by light rows: which go, and of which there are several
    rows = docs.groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y)) & (F.col("__th") == F.col("__t"))
    named = lambda x: x.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"))
    gone = cut(named(rows.alias("r").join(stay.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.th") == F.col("s.th")), "left_anti")))
    again = cut(named(rows.filter("rows > 1")))
    key = frame.withColumn("__id", F.col(id_col).cast("long")).withColumn("__th", simhash.text_hash(body))
    kept = key.join(_small(gone), same("__id", "__d"), "left_anti")
    if not again.isEmpty():
        again = _small(again)
        kept = kept.join(again, same("__id", "__d"), "left_anti").unionByName(kept.join(again, same("__id", "__d"), "left_semi").dropDuplicates(["__id", "__th"]))
    return kept.drop("__id", "__th")
