"""Whole operators against plain versions, where SQL can't tell."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from thicket.llm import bpe, crf, gif, language, line_dedup, mixing, oph, simhash, window_dedup

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def corpus(n, seed=1):
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 60))) for _ in range(n // 2)]
    while len(rows) < n:
        words = draw.choice(rows).split()
        words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append(" ".join(words))
    return rows


def test_simhash_against_all_pairs(spark):
    texts = [*corpus(400), None, "", " \t", "One TWO", "one two"]

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [plain(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], find(i)) for i in range(len(texts))}


def test_oph_likeness(spark):
    draw = random.Random(8)
    rows, true = [], {}
    for i in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(40, 400))]
        rows.append((i, " ".join(words)))
    shingles = lambda t: {tuple(t.split()[k : k + oph.WORDS]) for k in range(max(1, len(t.split()) - oph.WORDS + 1))}
    by_id = dict(rows)
    for i, text in rows:
        after = by_id[i - 1 if i else 59]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b = shingles(text), shingles(edited)
        true[i] = (edited, len(a & b) / len(a | b))
    got = oph.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "edited", oph.likeness(F.col("bins"), F.col("edited_bins")).alias("near"), oph.packed(F.col("bins")).alias("fp")).collect()
    assert all(r["edited"] == true[r["doc_id"]][0] for r in got)
    errors = np.array([r["near"] - true[r["doc_id"]][1] for r in got])
    assert abs(errors.mean()) < 0.015 and np.abs(errors).max() < 0.13
    again = {r["doc_id"]: r["f"] for r in oph.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), out="f").collect()}
    assert again == {r["doc_id"]: r["fp"] for r in got}


@pytest.mark.parametrize("size", [1 << 10, 1 << 11])
def test_window_dedup_tells_thue_morse_words_apart(spark, size):
    word = "".join("ab"[i.bit_count() & 1] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"r{i}" for i in range(19))
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (top, f"{other} {rest}"), (None, f"{other} {rest}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in window_dedup.dedupe(docs).collect()}
    assert got == {1: 0, top: 0, None: 20}


def test_bpe_on_long_stretches(monkeypatch):
    enc = bpe.encoding(PATH, P.PATTERN)
    spaces = bpe._SPACE
    monkeypatch.setattr(bpe, "LONG", 6)
    monkeypatch.setattr(bpe, "_BLANKS", re.compile(f"[{spaces}]{{6,}}"))
    monkeypatch.setattr(bpe, "_EITHER", re.compile(f"[{spaces}]{{6,}}|[{spaces}]?[^{spaces}]{{6,}}"))
    draw = random.Random(3)
    parts = ["a", "b", " ", "\n", "\t", "'s", "1", "!", "é", "　", "\x1c", "\x85", "ab", "  "]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(40)))
        assert bpe.encode(text, PATH, P.PATTERN, size=5) == enc.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", " " * 1_000_000, "x" * 300_000, "!" * 100_000 + "\n" * 100_000])
def test_bpe_splits_as_the_pattern_does(text):
    ids = bpe.encode(text, PATH, P.PATTERN)
    assert bpe.decode(ids, PATH, P.PATTERN) == text.encode()
    pieces = [text[:1], text[1:-2], text[-2:]] if "b" in text else regex.findall(P.PATTERN, text)
    assert ids == [i for p in pieces for i in bpe.merged(p.encode(), bpe.ranks(PATH))]


def plain_lzw(stream, bits):
    """One code after another, bit by bit."""
    clear, at, out = 1 << bits, 0, []
    number = int.from_bytes(stream, "little")
    table, width, last = [], bits + 1, None
    while at + width <= 8 * len(stream):
        code = number >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == clear + 1:
            break
        now = table[code] if code < len(table) else last + last[:1]
        out.append(now)
        if last is not None and len(table) < 4096:
            table.append(last + now[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        last = now
    return b"".join(out)


def plain_shown(data):
    """What a plain viewer shows of a file as ``write`` makes it: red of each frame's own rows."""
    w, h = struct.unpack_from("<HH", data, 6)
    common, at, out = data[13 : 13 + 768], 13 + 768, b""
    canvas = [[None] * w for _ in range(h)]
    while data[at] != 0x3B:
        assert data[at : at + 3] == b"\x21\xf9\x04"
        flags, _, clear = struct.unpack_from("<BHB", data, at + 3)
        at += 8
        _, _, fw, fh, own = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if own & 0x80:
            palette, at = data[at : at + 768], at + 768
        bits, at, stream = data[at], at + 1, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        samples, before = plain_lzw(stream, bits), [row[:] for row in canvas]
        for i, s in enumerate(samples):
            if not (flags & 1 and s == clear):
                canvas[i // fw][i % fw] = palette[3 * s]
        out += bytes(x for row in canvas[:fh] for x in row)
        if flags >> 2 & 7 == 2:
            for row in canvas[:fh]:
                row[:fw] = [None] * fw
        elif flags >> 2 & 7 == 3:
            canvas = before
    return out


def test_gif_round_trip_against_a_plain_viewer(spark):
    draw = random.Random(12)
    texts = [None, "", "a", "x" * 64, "x" * 65, "ab" * 9000, "Zwölf ünd \U0001f600\n" * 700, "".join(chr(draw.randrange(32, 900)) for _ in range(9000)), "ab" * 9000]
    got = sorted(gif.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
    for r, text in zip(got, texts, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = gif.write(payload)
        assert plain_shown(media) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert tuple(got[5])[1:] == tuple(got[8])[1:]
    frames = gif.parse(gif.write(gif.payload_of("ab" * 9000))).frames
    assert {f.disposal for f in frames} == {1, 2, 3} and any(f.transparent is not None for f in frames) and len({f.palette.tobytes() for f in frames}) == 2


@pytest.mark.parametrize("bits", [2, 3, 7, 8])
def test_lzw(bits):
    draw = random.Random(bits)
    for n in (0, 1, 50, 30_000):
        samples = bytes(draw.randrange(draw.choice([1, 2, 1 << bits])) for _ in range(n))
        stream = gif.lzw_encode(samples, bits)
        assert gif.lzw_decode(stream, bits, n) == plain_lzw(stream, bits) == samples


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit_from(docs, ~held)
    rows = language.identify(docs.filter(held), model).filter("lang is not null and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0
    # nothing to learn from, and one label alone
    assert language.fit_from(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    one = language.fit_from(docs.withColumn("lang", F.lit("xx")), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs.limit(5), one).collect()} <= {"xx", "und"}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = crf.fit_from(docs, labels, ~held)
    rows = crf.score_texts(docs.join(labels, "doc_id"), model).select("text", "toxic", "score", "spans", held.alias("held")).collect()
    # words that only toxic documents of the fit hold, and several of them
    words = lambda r: set(re.findall(r"[a-z']+", (r["text"] or "").lower()))
    bad, good = (Counter(w for r in rows if r["toxic"] == t and not r["held"] for w in words(r)) for t in (1, 0))
    sure = {w for w, n in bad.items() if n >= 8 and not good[w]}
    tests = [r for r in rows if r["held"]]
    telling = [r for r in tests if r["toxic"] and words(r) & sure]
    assert len(telling) >= 10 and sum(r["score"] >= 0.7 for r in telling) >= 0.9 * len(telling)
    clean = [r for r in tests if not r["toxic"]]
    assert sum(r["score"] >= 0.7 for r in clean) <= 0.02 * len(clean)
    for r in telling:
        raw = r["text"].encode()
        spans = {raw[s["start"] : s["end"]].decode().lower() for s in r["spans"]}
        assert any(w in " ".join(spans) for w in sure)


def test_long_chains():
    draw = np.random.default_rng(2)
    emission, trans = draw.normal(size=300), draw.normal(size=(2, 2))
    got = crf.forward_backward(emission, np.zeros(300, int), trans)[0]
    # by sums of products over tags
    step = np.exp(trans)
    forward, backward = np.zeros((300, 2)), np.ones((300, 2))
    odds = np.stack([np.ones(300), np.exp(emission)], axis=1)
    forward[0] = odds[0]
    for t in range(1, 300):
        forward[t] = forward[t - 1] @ step * odds[t]
        forward[t] /= forward[t].sum()
    for t in range(298, -1, -1):
        backward[t] = step @ (odds[t + 1] * backward[t + 1])
        backward[t] /= backward[t].sum()
    both = forward * backward
    assert np.allclose(got, np.log(both[:, 1] / both[:, 0]))


def test_mixing_entropy_and_many_sources(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 3), f"s{min(i % 11, i % 4)}") for i in range(500)] + [(900 + i, "", f"empty{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.shares(mixing._light(docs, "doc_id", "source", "text"))
    target = 1.375  # between that of the shares, 1.365, and that of equal weights, 1.386
    a = mixing.exponent(found, entropy=target)
    assert abs(found.entropy(a) - target) < 1e-6 and 0 < a < 1
    plain = sorted(map(tuple, mixing.draws(docs, max_repeats=2.0).collect()))
    again = sorted(map(tuple, mixing.realise(docs, max_repeats=2.0).select("doc_id").collect()))
    monkeypatch.setattr(mixing, "LOCAL", 5)  # more sources than that: no broadcast, sums by aggregates
    far = mixing.shares(mixing._light(docs, "doc_id", "source", "text"))
    assert far.local is None and abs(far.entropy(a) - found.entropy(a)) < 1e-9
    assert sorted(map(tuple, mixing.draws(docs, max_repeats=2.0).collect())) == plain
    assert sorted(map(tuple, mixing.realise(docs, max_repeats=2.0).select("doc_id").collect())) == again


def test_line_dedup_over_all_runs(spark):
    draw = random.Random(5)
    lines = ["one two", "three", "", " ", "four five six", "last"]
    texts = ["\n".join(draw.choice(lines + [f"own {i} {k}" for k in range(4)]) for _ in range(draw.randrange(1, 12))) for i in range(40)]
    texts += ["\n".join(["a", "b", "", "c"] * 40), "\n".join(["x y"] * 300), "one two", None]
    for least in (1, 4):
        seen, want = set(), {}
        for i, text in enumerate(texts):
            own, gone = (text or "").split("\n"), set()
            for s in range(len(own)):
                for e in range(s + 1, min(len(own), s + 30) + 1):
                    if sum(len(x.split()) for x in own[s:e]) >= least:
                        if tuple(own[s:e]) in seen:
                            gone.update(range(s, e))
                        seen.add(tuple(own[s:e]))
            want[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["text"] or "" for r in line_dedup.dedupe(docs, min_words=least).collect()}
        assert got == want
