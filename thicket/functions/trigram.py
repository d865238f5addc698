"""Byte trigrams of texts and the 4096-bit filters made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Filter bits, and the two FNV-1a seeds and the prime modulo 4096.
BITS = 4096
SEEDS = (2166136261 % BITS, 0x5E18FF4E % BITS)
PRIME = 16777619 % BITS


def trigrams(text: Column) -> Column:
    """All byte trigrams in order, six hexadecimal digits each; meant for short texts, as positions are counted in characters."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(digits, 2 * i - 1, F.lit(6)))).otherwise(F.array().cast("array<string>"))


def of_bytes(data: bytes) -> np.ndarray:
    """Distinct trigrams as numbers b0 << 16 | b1 << 8 | b2."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:])


def bit_positions(grams: np.ndarray) -> np.ndarray:
    """The two filter bits of each trigram: FNV-1a kept modulo 4096, which multiplication and addition allow and low bits of xor don't leave."""
    out = []
    for h in SEEDS:
        for shift in (16, 8, 0):
            h = (h ^ (grams >> shift & 255)) * PRIME % BITS
        out.append(h)
    return np.stack(out, axis=-1) if len(grams) else np.empty((0, 2), np.int64)


def bits_of(data: bytes) -> list[int]:
    """Set bits of a file's filter, in order."""
    return np.unique(bit_positions(of_bytes(data))).tolist()


def bitmap(bits: list[int]) -> bytes:
    """The 512-byte form: bit i is bit i % 8 of byte i // 8."""
    out = bytearray(BITS // 8)
    for i in bits:
        out[i >> 3] |= 1 << (i & 7)
    return bytes(out)


def from_bitmap(data: bytes) -> list[int]:
    if len(data) != BITS // 8:
        raise ValueError("a filter has 512 bytes")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).tolist()


def with_bits(frame: DataFrame, content: str = "content", out: str = "bits") -> DataFrame:
    """Add the set bits of each row's filter, one Arrow pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in frame.columns if c != out]
    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        target = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bits = [None if x is None else bits_of(x) for x in part.column(part.schema.get_field_index(content)).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).cast(target.field(c).type) for c in kept), pa.array(bits, target.field(out).type)], schema=target)

    return frame.mapInArrow(run, schema)


def gram_bits(gram: Column) -> Column:
    """The two filter bits of a trigram in hexadecimal, as a column expression."""
    byte = lambda i: F.conv(F.substring(gram, 2 * i + 1, 2), 16, 10).cast("int")
    out = []
    for seed in SEEDS:
        h = F.lit(seed)
        for i in range(3):
            h = (h.bitwiseXOR(byte(i)) * PRIME) % BITS
        out.append(h)
    return F.array(*out)


def contains_all(bits: Column, wanted: list[int]) -> Column:
    """Whether all wanted bits are set; none wanted: true."""
    return F.size(F.array_except(F.array(*(F.lit(i) for i in wanted)).cast("array<int>"), bits)) == 0 if wanted else F.lit(True)


def false_positive_rate(bits: Column) -> Column:
    """Estimated chance that an absent trigram seems present."""
    return F.pow(F.size(bits) / F.lit(float(BITS)), F.lit(2.0))
