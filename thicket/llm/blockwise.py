"""Exchange of hashes between blocks of documents.

A corpus is dealt into *blocks* of a bounded number of text bytes, by a hash of
id and text, so that one block always fits a Python worker. A stage emits, for
every block, packed rows of fixed-width records dealt by hash to *buckets*;
equal records of one block are emitted once, so a passage that a third of all
documents hold costs one record a block. A bucket's reducer compares the blocks'
records and answers with packed rows addressed to blocks. Hashes of 128 bits are
compared and answered whole. The block's texts are shuffled once: every stage
groups by the same column, and Spark reuses the exchange within the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block, on average.
BLOCK_BYTES = 4 << 20
#: Bytes of records of a bucket, on average.
BUCKET_BYTES = 4 << 20

PACKED = "bucket long, block long, kind int, records binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("records", pa.binary())])

HASH = np.dtype("<u8")
#: A hash of 128 bits.
PAIR = np.dtype([("hash", "<u8"), ("more", "<u8")])
#: A record that is compared by hash and has an earliest owner: a document without an id comes after all others.
OWNED = np.dtype([("hash", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("none", "u1")])


def text_bytes(frame: DataFrame, text: str = "text") -> int:
    """All text bytes; one aggregate over the whole column."""
    return frame.agg(F.sum(F.octet_length(text))).first()[0] or 0


def with_blocks(frame: DataFrame, total: int, id_col: str, text: str) -> DataFrame:
    """Columns doc_id, text (binary, null: empty) and block. Rows of equal id and text share a block."""
    count = max(1, -(-total // BLOCK_BYTES))
    key = F.xxhash64(F.col(id_col), F.col(text))
    return frame.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.pmod(key, F.lit(count)).alias("block"))


class Texts:
    """A block's documents by id (null ids last) and then text: ids, which of them are null, texts, 128-bit digests, and which texts came before."""

    def __init__(self, table: pa.Table) -> None:
        column = table.column("doc_id")
        none, ids = column.is_null().to_numpy(), column.fill_null(0).to_numpy()
        texts = table.column("text").to_pylist()
        order = np.lexsort((ids, none))
        ids, none = ids[order], none[order]
        if len(ids) > 1 and ((ids[1:] == ids[:-1]) & (none[1:] == none[:-1])).any():
            order = np.array(sorted(order.tolist(), key=lambda i: (column[i].as_py() is None, column[i].as_py() or 0, texts[i])))
        self.ids, self.none = ids, none
        self.texts = [texts[i] for i in order]
        self.a, self.b = digests(self.texts)
        _, first = first_of_each(self.a, self.b)
        self.again = ~first

    def arrow_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.none)

    def owned(self, docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Records of hashes that belong to documents."""
        records = np.empty(len(docs), OWNED)
        records["hash"], records["more"], records["doc"], records["none"] = a, b, self.ids[docs], self.none[docs]
        return records


def digests(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hash of each byte string."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in parts]), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def deal(block: int, kind: int, records: np.ndarray, hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Packed rows of records, each bucket's together."""
    if not len(records):
        return
    to = bucket_of(hashes, buckets)
    order = np.argsort(to, kind="stable")
    records, to = records[order], to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for part, bucket in zip(np.split(records, cuts), to[np.r_[0, cuts]], strict=True):
        yield int(bucket), block, kind, part.tobytes()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def table_of(rows: Iterable[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def gathered(table: pa.Table, kind: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of one kind and the block of each."""
    parts = [(np.frombuffer(r, dtype), b) for k, b, r in zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("records").to_pylist(), strict=True) if k == kind]
    if not parts:
        return np.empty(0, dtype), np.empty(0, np.int64)
    return np.concatenate([r for r, _ in parts]), np.repeat(np.array([b for _, b in parts], np.int64), [len(r) for r, _ in parts])


def answers(kind: int, records: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows addressed to blocks."""
    if len(records):
        order = np.argsort(blocks, kind="stable")
        records, blocks = records[order], blocks[order]
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for part, block in zip(np.split(records, cuts), blocks[np.r_[0, cuts]], strict=True):
            yield 0, int(block), kind, part.tobytes()


def in_several_blocks(hashes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which records have a hash that another block has, too. A block has each hash once."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(order) else False
    return out


def owned_elsewhere(records: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which OWNED records have an earlier owner in another block: a smaller id, or an equal id in a smaller block."""
    order = np.lexsort((blocks, records["doc"], records["none"], records["more"], records["hash"]))
    r = records[order]
    out = np.zeros(len(records), bool)
    if len(r):
        out[order] = np.r_[False, (r["hash"][1:] == r["hash"][:-1]) & (r["more"][1:] == r["more"][:-1])]
    return out


def pairs(records: np.ndarray) -> np.ndarray:
    """The hashes of records that have both halves."""
    out = np.empty(len(records), PAIR)
    out["hash"], out["more"] = records["hash"], records["more"]
    return out


def first_of_each(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values (first, second) in order of occurrence: indices of first occurrences, and for every value whether it is one."""
    order = np.lexsort((second, first))  # stable: equal values stay in order
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    is_first = np.zeros(len(order), bool)
    is_first[order[new]] = True
    return order[new], is_first


def is_among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Membership of 64-bit hashes by binary search."""
    if not len(those) or not len(values):
        return np.zeros(len(values), bool)
    those = np.sort(those)
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values


def index_among(a: np.ndarray, b: np.ndarray, those_a: np.ndarray, those_b: np.ndarray) -> np.ndarray:
    """Where each 128-bit hash (a, b) stands among others, which are sorted by both halves; -1: nowhere."""
    out = np.full(len(a), -1, np.int64)
    if not len(those_a):
        return out
    left = np.arange(len(a))
    at = np.searchsorted(those_a, a)
    while len(left):  # more than one turn only where halves are equal and the others aren't
        ok = at < len(those_a)
        left, at = left[ok], at[ok]
        ok = those_a[at] == a[left]
        left, at = left[ok], at[ok]
        hit = those_b[at] == b[left]
        out[left[hit]] = at[hit]
        left, at = left[~hit], at[~hit] + 1
    return out


def pair_among(a: np.ndarray, b: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Membership of 128-bit hashes among PAIR records."""
    those = those[np.lexsort((those["more"], those["hash"]))]
    return index_among(a, b, np.ascontiguousarray(those["hash"]), np.ascontiguousarray(those["more"])) >= 0
