"""Media columns: GIF files as binary columns, decoded to timed frames with colour histograms.

``parse`` reads a GIF: it cuts the LZW code stream into codes a table generation
at a time (the widths follow from the number of codes since the last clear code,
so a generation is cut in one vectorised step), expands them, undoes interlacing
and keeps palette, delay, disposal and transparency of each frame. ``compose``
shows what a viewer would at each frame. ``write`` stores any bytes losslessly
in what the frames of an animation show: rows of 64 pixels, whose red is the byte,
in frames of ``FRAME_ROWS`` rows. Every other frame has a palette of its own, a
pixel that already shows its byte is transparent, and frames stay, are cleared or
give way to what was there before in turn; ``shown_bytes`` reads them back.

Defined results: null text is empty; the payload is padded to a positive multiple
of 64 bytes; a file that isn't a readable GIF gives null frames and the reason in
``error``, and so does one with a canvas or frame of more than ``CANVAS`` pixels;
null media give null for both; a stream that ends early leaves the rest of its
frame at sample 0; equal inputs give equal outputs; other columns are
kept, new ones replace equally named ones; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = 64
#: Rows of a frame that ``write`` makes; larger payloads become several frames.
FRAME_ROWS = 64
#: Most pixels of a canvas, and of a frame, that is decoded.
CANVAS = 1 << 24
#: Hundredths of a second a written frame is shown.
DELAY = 10
#: Most codes that are valid in one table.
TABLE = 4096
#: Levels of each colour in a histogram.
LEVELS = 4

# Fixed values of the format: starts of interlace passes and their steps.
_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


class GifError(ValueError):
    """The bytes aren't a readable GIF."""


def _widths(bits: int, count: int) -> np.ndarray:
    """Bit widths of the first codes after a clear code; a code's entry exists once the next code is read."""
    known = (1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(known)).astype(np.int64) + 1))


_WIDTHS = {bits: _widths(bits, TABLE + 2) for bits in range(1, 12)}
_OFFSETS = {bits: np.r_[0, np.cumsum(w)] for bits, w in _WIDTHS.items()}


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of samples below 2^bits."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, table, free = [clear], {}, end + 1
    known, add = table.get, codes.append
    if samples:
        prefix = samples[0]
        for sample in memoryview(samples)[1:]:
            key = prefix << 8 | sample
            found = known(key)
            if found is not None:
                prefix = found
                continue
            add(prefix)
            table[key] = free
            free += 1
            prefix = sample
            if free == TABLE:
                add(clear)
                table, free = {}, end + 1
                known = table.get
        add(prefix)
    add(end)
    all_codes = np.array(codes, np.int64)
    heads = np.flatnonzero(all_codes == clear)
    since = np.arange(len(all_codes)) - heads[np.searchsorted(heads, np.arange(len(all_codes)), "left") - 1] - 1
    since[0] = 0
    width = _WIDTHS[bits][since]
    at = np.r_[0, np.cumsum(width)]
    value = all_codes << (at[:-1] & 7)
    out = np.zeros(int(at[-1] + 7) // 8 + 3, np.uint8)
    if bits >= 7:  # codes of eight bits or more start in bytes of their own
        for byte in range(3):
            out[(at[:-1] >> 3) + byte] += (value >> 8 * byte & 255).astype(np.uint8)
    else:
        for byte in range(3):
            np.add.at(out, (at[:-1] >> 3) + byte, (value >> 8 * byte & 255).astype(np.uint8))
    return out[: int(at[-1] + 7) // 8].tobytes()


def lzw_decode(stream: bytes, bits: int, limit: int) -> bytes:
    """At most ``limit`` samples of a code stream."""
    if not 1 <= bits <= 11:
        raise GifError(f"minimum code size {bits}")
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int64)
    total, at, out, size = 8 * len(stream), 0, [], 0
    roots = [bytes((i,)) for i in range(min(clear, 256))] + [b""] * (clear + 2 - min(clear, 256))
    table, last, since = roots[:], b"", 0
    while at + bits < total and size < limit:
        # offsets of the codes to come if no clear code does
        if since < TABLE:
            offset = _OFFSETS[bits][since:] - _OFFSETS[bits][since]
        else:
            offset = 12 * np.arange(TABLE + 1)
        offset = at + offset
        n = int(np.searchsorted(offset, total, "right")) - 1
        if n <= 0:
            break
        start = offset[:n]
        low = start >> 3
        codes = (data[low] | data[low + 1] << 8 | data[low + 2] << 16) >> (start & 7) & (1 << np.diff(offset[: n + 1])) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))
        m = int(stop[0]) if len(stop) else n
        free = len(table)
        for code in codes[:m].tolist():
            if code < free:
                now = table[code]
            elif code == free and last:
                now = last + last[:1]
            else:
                raise GifError(f"code {code} before its entry")
            if last and free < TABLE:
                table.append(last + now[:1])
                free += 1
            out.append(now)
            size += len(now)
            last = now
        since += m
        at = int(offset[m])
        if len(stop):
            at = int(offset[m + 1])
            if codes[m] == end:
                break
            table, last, since = roots[:], b"", 0
    return b"".join(out)[:limit]


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # rows of palette indices
    palette: np.ndarray  # rows of red, green, blue
    delay: int  # hundredths of a second
    disposal: int
    transparent: int | None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray
    frames: list[Frame]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def parse(data: bytes) -> Gif:
    """Read a GIF of either version."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no header")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > CANVAS:
        raise GifError(f"canvas of {width} by {height}")
    at = 13

    def colours(flags, at):
        n = 3 << ((flags & 7) + 1)
        found = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3)
        return found, at + n

    common = np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        common, at = colours(flags, at)
    gif, control = Gif(width, height, background, common, []), (0, 0, None)
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            block, at = _blocks(data, at + 1)
            if label == 0xF9 and len(block) >= 4:
                f, delay, index = struct.unpack_from("<BHB", block)
                control = (delay, f >> 2 & 7, index if f & 1 else None)
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise GifError("frame cut off")
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at)
            at, palette = at + 9, common
            if w * h > CANVAS:
                raise GifError(f"frame of {w} by {h}")
            if f & 0x80:
                palette, at = colours(f, at)
            if at >= len(data):
                raise GifError("frame cut off")
            bits = data[at]
            stream, at = _blocks(data, at + 1)
            found = np.frombuffer(lzw_decode(stream, bits, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if f & 0x40:
                order = [y for first, step in _PASSES for y in range(first, h, step)]
                found, shuffled = np.empty_like(found), found
                found[order] = shuffled
            gif.frames.append(Frame(left, top, found, palette, *control))
            control = (0, 0, None)
        elif kind:
            raise GifError(f"block {kind:#x}")
    return gif


def compose(gif: Gif) -> Iterator[np.ndarray]:
    """What is seen at each frame, until the next one is asked for: rows of red, green, blue, alpha. Disposal 2 clears a frame's area afterwards, 3 brings back what was there before."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        # a pixel's four bytes are drawn as one number
        area = canvas.view(np.uint32)[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1], 0]
        samples = f.samples[: area.shape[0], : area.shape[1]]
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(f.palette), :3], palette[:, 3] = f.palette, 255
        colours = palette.view(np.uint32)[:, 0].take(samples)
        np.copyto(area, colours, where=True if f.transparent is None else samples != f.transparent)
        yield canvas
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


_LEVEL = (np.arange(256) * LEVELS >> 8).astype(np.uint8)


def histogram(seen: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels by colour, each channel cut to ``LEVELS`` levels; last: pixels that show nothing."""
    colour = (_LEVEL.take(seen[..., 0]) * np.uint8(LEVELS) + _LEVEL.take(seen[..., 1])) * np.uint8(LEVELS) + _LEVEL.take(seen[..., 2])
    colour[seen[..., 3] == 0] = LEVELS**3
    return np.bincount(colour.ravel(), minlength=LEVELS**3 + 1)


#: The colour of each byte: its red is the byte itself.
_COLOURS = np.stack([np.arange(256), np.arange(256) * 5 % 256, np.arange(256) * 11 % 256], axis=1).astype(np.uint8)
#: Disposals of written frames, in turn.
_DISPOSALS = (1, 2, 3)


def write(payload: bytes) -> bytes:
    """A GIF whose frames show the payload (a multiple of 64 bytes)."""
    rows = len(payload) // ROW
    pixels = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    parts = [b"GIF89a", struct.pack("<HHBBB", ROW, max(1, min(rows, FRAME_ROWS)), 0xF7, 0, 0), _COLOURS.tobytes()]
    canvas = np.full((FRAME_ROWS, ROW), -1, np.int16)  # the byte that each pixel shows; -1: none
    for number, at in enumerate(range(0, rows, FRAME_ROWS)):
        want = pixels[at : at + FRAME_ROWS]
        h, own, disposal = len(want), number % 2 == 1, _DISPOSALS[number % 3]
        samples = ~want if own else want  # a palette of its own runs backwards
        free = np.flatnonzero(np.bincount(samples.ravel(), minlength=256) == 0)
        there = want == canvas[:h]
        see_through = len(free) > 0 and bool(there.any())
        clear = int(free[0]) if see_through else 0
        if see_through:
            samples = np.where(there, np.uint8(clear), samples)
        stream = lzw_encode(samples.tobytes())
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | see_through, DELAY, clear, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, ROW, h, 0x87 if own else 0))
        parts.append((_COLOURS[::-1].tobytes() if own else b"") + b"\x08")
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            parts += [bytes((len(block),)), block]
        parts.append(b"\0")
        if disposal == 1:
            canvas[:h] = want
        elif disposal == 2:
            canvas[:h] = -1
    return b"".join([*parts, b";"])


def shown_bytes(frame: Frame, seen: np.ndarray) -> bytes:
    """The bytes that a written frame shows."""
    return seen[: frame.samples.shape[0], :, 0].tobytes()


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")


def _mapped(frame: DataFrame, fields: list[T.StructField], source: str, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in frame.columns if c not in {f.name for f in fields}]
    schema = T.StructType([*(frame.schema[c] for c in kept), *fields])

    def run(batches):
        target = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                new = zip(*map(make, part.column(part.schema.get_field_index(source)).to_pylist()), strict=True)
                columns = [part.column(part.schema.get_field_index(c)).cast(target.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(list(x), target.field(f.name).type) for x, f in zip(new, fields, strict=True))], schema=target)

    return frame.mapInArrow(run, schema)


def store_texts(frame: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add the GIF of every whole text."""
    return _mapped(frame, [T.StructField(media, T.BinaryType())], text, lambda x: (write(payload_of(x)),))


def decode_media(frame: DataFrame, media: str = "media", frames: str = "frames", error: str = "error") -> DataFrame:
    """Add an array of timed frames with the colour histogram of what each shows, and why a file couldn't be read."""
    one = T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("duration_ms", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("histogram", T.ArrayType(T.LongType()))])

    def make(data):
        if data is None:
            return None, None
        try:
            gif = parse(data)
        except GifError as e:
            return None, str(e)
        out, start = [], 0
        for f, shown in zip(gif.frames, compose(gif), strict=True):
            out.append({"start_ms": start, "duration_ms": 10 * f.delay, "width": f.samples.shape[1], "height": f.samples.shape[0], "histogram": histogram(shown).tolist()})
            start += 10 * f.delay
        return out, None

    return _mapped(frame, [T.StructField(frames, T.ArrayType(one)), T.StructField(error, T.StringType())], media, make)


def _feature(frames: int, duration: int, counts: np.ndarray) -> str:
    """Frames, duration in milliseconds and the colour histogram of all that is shown: colour and count in hexadecimal."""
    return f"{frames}:{duration}:" + ",".join(f"{i:x}={int(counts[i]):x}" for i in np.flatnonzero(counts))


def round_trip(frame: DataFrame, text: str = "text") -> DataFrame:
    """Store every whole text, read what the stored frames show, and keep sizes, digests and a feature of what was read."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]

    def make(x):
        media = write(payload_of(x))
        gif = parse(media)
        back, counts = [], np.zeros(LEVELS**3 + 1, np.int64)
        for f, seen in zip(gif.frames, compose(gif), strict=True):
            back.append(shown_bytes(f, seen))
            counts += histogram(seen)
        back = b"".join(back)
        return len((x or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(len(gif.frames), sum(10 * f.delay for f in gif.frames), counts)

    return _mapped(frame.withColumn(text, F.col(text).cast("string")), fields, text, make)
