"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within ``DISTANCE`` differing bits are linked. The 64 bits are cut
into eight bytes; two fingerprints that differ in at most two bits agree in six
of them at least. Each choice of six bytes with the values they hold is an
*upper node* of the index: a mask and the pattern its members share. A
fingerprint goes to its 28 upper nodes, and a node holds 2^16 fingerprints at
most, since 16 bits are left. Within a node, members are sorted by Gray rank, so
neighbours differ in few bits, and runs of ``FAN`` neighbours become lower nodes
that factor out the bits all their members share. A search goes down level by
level, adds up the differences found in each node's own bits, and drops the
whole group once they exceed the distance. In 16 free bits a member has at most
136 others within two bits, so the links stay in proportion to the input; each
node's links are reduced to one for each member before they are shuffled.

Only distinct fingerprints enter the index: copies are aggregated first.

Defined results: null and blank texts have fingerprint zero and are linked like
any other; rows with a null id are linked, too, but never name a component
(null, if a component has no other); repeated rows each get their result. The
results have the columns named below only, so extra columns don't clash. An
empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import components
from thicket.llm.lineage import cut

DISTANCE = 2
#: Children of a lower node.
FAN = 8
#: Pairs of fingerprint and node looked at together.
FRONTIER = 1 << 18
#: Shingle hashes expanded to bits together.
_HASHES = 1 << 15

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Masks of the upper nodes: all choices of six bytes.
MASKS = [sum(0xFF << (8 * i) for i in range(8) if i not in free) for free in combinations(range(8), 2)]


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """Hashes of one whole text's shingles, in order."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return np.empty(0, "<u8")
    shingles = [b" ".join(x) for x in zip(*(found[i:] for i in range(words)), strict=False)] if len(found) >= words else [b" ".join(found)]
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        counts += np.unpackbits(hashes[at : at + _HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    return majority(shingle_hashes(text, words))


def fingerprints(frame: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint's 64 bits as a signed long) for every row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    body = F.col(text).cast("string")
    return frame.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(body).alias("th"), body.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def text_hash(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Positions of the codes in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def close_pairs(fps: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of fingerprints of one group that differ in at most ``distance`` bits.

    Fingerprints are in order of group and Gray rank. All groups' trees are searched together.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(fps) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(fps)] if len(fps) else starts
    levels = []  # from the leaves up: first and past-the-end child of each node, mask and pattern of the bits its members share
    mask, pattern, tree = np.full(len(fps), ~np.uint64(0)), fps, np.repeat(np.arange(len(starts)), ends - starts)
    last = np.arange(len(fps))  # the last leaf under each node
    while len(mask) > len(starts):
        first_of_tree = np.searchsorted(tree, np.arange(len(starts)))
        offset = np.arange(len(mask)) - first_of_tree[tree]
        heads = np.flatnonzero(offset % FAN == 0)
        tails = np.r_[heads[1:], len(mask)]
        levels.append((heads, tails, mask, pattern, last))
        agree = np.bitwise_and.reduceat(mask, heads) & ~(np.bitwise_or.reduceat(pattern, heads) ^ np.bitwise_and.reduceat(pattern, heads))
        mask, pattern, tree, last = agree, pattern[heads] & agree, tree[heads], last[tails - 1]
    found_a, found_b = [], []
    root = np.repeat(np.arange(len(starts)), ends - starts)
    for at in range(0, len(fps), FRONTIER // 64):
        query = np.arange(at, min(len(fps), at + FRONTIER // 64))
        node = root[query]
        seen, spent = mask[node], np.bitwise_count((fps[query] ^ pattern[node]) & mask[node]).astype(np.int64)
        for heads, tails, child_mask, child_pattern, child_last in reversed(levels):
            keep = spent <= distance
            query, node, seen, spent = query[keep], node[keep], seen[keep], spent[keep]
            many = tails[node] - heads[node]
            up = np.repeat(np.arange(len(node)), many)
            child = heads[node][up] + np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
            later = child_last[child] > query[up]
            up, child = up[later], child[later]
            query = query[up]
            own = child_mask[child] & ~seen[up]
            spent = spent[up] + np.bitwise_count((fps[query] ^ child_pattern[child]) & own)
            node, seen = child, child_mask[child]
        keep = (spent <= distance) & (node > query)
        found_a.append(query[keep])
        found_b.append(node[keep])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component under links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def _search(batches):
    """Rows come sorted by upper node; a node that a batch may not have ended waits for the next batch."""
    import itertools

    waiting: list[pa.RecordBatch] = []

    def links(table):
        which, pattern, fps = (table.column(i).to_numpy() for i in range(3))
        new = np.r_[True, (which[1:] != which[:-1]) | (pattern[1:] != pattern[:-1])]
        group = np.cumsum(new)
        size = np.bincount(group)
        several = size[group] > 1
        group, fps = group[several], fps[several].view(np.uint64)
        order = np.lexsort((gray_rank(fps), group))
        group, fps = group[order], fps[order]
        a, b = close_pairs(fps, group)
        label = least_labels(len(fps), a, b)
        member = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[member].view(np.int64)), pa.array(fps[label[member]].view(np.int64))], ["a", "b"])

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            which, pattern = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((which != which[-1]) | (pattern != pattern[-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if not cut_at:
                waiting.append(batch)
                if waiting[0].column(0)[0] == batch.column(0)[0] and waiting[0].column(1)[0] == batch.column(1)[0]:
                    continue
                done, waiting = waiting[:-1], [batch]
            else:
                done, waiting = [*waiting, batch.slice(0, cut_at)], [batch.slice(cut_at)]
        else:
            done, waiting = waiting, []
        if done:
            yield links(pa.Table.from_batches(done))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect all that are close; ``fps`` holds distinct values in fp."""
    nodes = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("pattern")) for i, m in enumerate(MASKS))))
    rows = fps.select("fp", nodes.alias("node")).select("node.which", "node.pattern", "fp")
    return rows.repartition("which", "pattern").sortWithinPartitions("which", "pattern").mapInArrow(_search, "a long, b long").distinct()


def _roots(docs: DataFrame) -> DataFrame:
    """(fp, root): the least linked fingerprint of each distinct one."""
    distinct = cut(docs.select("fp").distinct())
    roots = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(frame: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest id linked to it, itself included) for every row."""
    docs = cut(fingerprints(frame, id_col, text, words).drop("th"))
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = cut(least.join(_roots(docs), "fp"))
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(frame: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``frame`` without those whose group has one with a smaller id (null: after all others), or an equal id and a smaller hash of its text. All columns stay; rows equal in id and text become one."""
    docs = cut(fingerprints(frame, id_col, text, words))
    first = docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    stay = first.join(_roots(docs), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__d"), F.col("first.th").alias("__t"))
    key = frame.withColumn("__id", F.col(id_col).cast("long")).withColumn("__th", text_hash(F.col(text).cast("string")))
    kept = key.join(stay, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left_semi")
    return kept.dropDuplicates(["__id", "__th"]).drop("__id", "__th")
