"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import bpe, crf, gif, language, line_dedup, mixing, oph, simhash, suffix_dedup, window_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, frames string, bins string, ids string, block string, s string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, f"one two three {PASSAGE} end", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", 1),
    (5, LONG, "en", "b", 1),
    (5, f"other {PASSAGE} words\n\nline", "en", "b", 1),
    (7, "same row", "en", "a", 1),
    (7, "same row", "en", "a", 1),
    (None, f"no id {PASSAGE}", "en", None, 1),
    (9, "ÄÖ ü \U0001f600 aa", "de", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "i", "b", "s") for r in ROWS], SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_kept(rows, size=20):
    seen, out = set(), []
    for _, text in sorted(((d, t) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        out.append(" ".join(w for i, w in enumerate(words) if i not in gone))
    return sorted(out)


def bytes_kept(rows, size=100):
    seen, out = set(), []
    for _, text in sorted(((d, t) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - size + 1):
            window = data[i : i + size]
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        out.append(bytes(c for i, c in enumerate(data) if i not in gone))
    return sorted(out)


def test_window_dedup(docs, empty):
    got = sorted(r["kept"] for r in window_dedup.dedupe(docs).collect())
    assert got == words_kept([(r[0], r[1]) for r in ROWS])
    assert window_dedup.dedupe(empty).count() == 0


def test_suffix_dedup(docs, empty):
    got = sorted(bytes(r["kept"]) for r in suffix_dedup.dedupe(docs).collect())
    assert got == bytes_kept([(r[0], r[1]) for r in ROWS])
    assert suffix_dedup.dedupe(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["fp"], r["component_id"]))
    assert by_id[2] == by_id[3] == [(0, 2)]
    assert by_id[4][0][1] == 4 and (by_id[4][0][0], 4) in by_id[5]
    assert by_id[7] == [by_id[7][0]] * 2
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs, words=5)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "2", "4", "5", "7", "9"]  # the row without id is near 1


def test_oph(docs, empty):
    rows = oph.edited_pairs(docs).select("doc_id", "n_chars", "edited", oph.likeness(F.col("bins"), F.col("edited_bins")).alias("near")).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["near"] <= 1 for r in rows)
    nine = next(r for r in rows if r["doc_id"] == 9)
    # nine characters: the last three are those that start the text of id 7
    assert nine["edited"] == "ÄÖ ü " + chr(0x1F600) + "sam"
    assert oph.edited_pairs(empty).count() == 0
    assert oph.fingerprints(docs, out="score").count() == len(ROWS)


def test_line_dedup(docs, empty):
    got = line_dedup.dedupe(docs, n_lines="s")
    assert got.count() == len(ROWS)
    # the repeated rows of one id and text are one document; the copy of another id loses its lines
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in got.select("doc_id", "text").collect())
    assert (5, "") in texts and texts.count((7, "same row")) == 2
    assert line_dedup.dedupe(empty).count() == 0


def test_mixing(docs, empty):
    drawn = mixing.draws(docs, max_repeats=2.0)
    assert {r["doc_id"] for r in drawn.collect()} == {r[0] for r in ROWS}
    again = mixing.realise(docs, max_repeats=2.0)
    assert again.columns == docs.columns
    # a row that ties with the last drawn one comes with it
    assert again.count() - drawn.count() in (0, 1)
    assert mixing.draws(empty, max_repeats=2.0).count() == 0 == mixing.realise(empty, max_repeats=2.0).count()


def test_bpe(docs, empty):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.round_trip(docs, path, P.PATTERN, keep_ids=True).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0
    enc = bpe.encoding(path, P.PATTERN)
    for text in (LONG, "a  b\n\n c", "x" * 300, " \t lead", "é ü's we'll"):
        assert bpe.encode(text, path, P.PATTERN, size=7) == enc.encode_ordinary(text)


def test_gif(docs, empty):
    stored = gif.store_texts(docs)
    back = gif.decode_media(stored).collect()
    for r in back:
        rows = len(gif.payload_of(r["text"])) // 64
        assert r["error"] is None and sum(f["height"] for f in r["frames"]) == rows
        assert all(sum(f["histogram"]) == 64 * min(rows, gif.FRAME_ROWS) for f in r["frames"])
    assert gif.decode_media(gif.store_texts(empty)).count() == 0
    with pytest.raises(gif.GifError):
        gif.parse(b"no gif")


def test_gif_disposal_and_transparency():
    def frame(samples, flags, delay, left=0, top=0, w=2, h=1, clear=0):
        import struct

        stream = gif.lzw_encode(bytes(samples), 2)
        return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, delay, clear, 0) + struct.pack("<BHHHHBB", 0x2C, left, top, w, h, 0, 2) + bytes((len(stream),)) + stream + b"\0"

    head = b"GIF89a" + bytes((2, 0, 1, 0, 0x81, 0, 0)) + bytes(range(12))
    data = head + frame([1, 2], 4, 5) + frame([3, 0], 1 | 3 << 2, 6) + frame([0, 1], 1 | 2 << 2, 7) + frame([0, 0], 1, 8) + b";"
    parsed = gif.parse(data)
    assert [f.delay for f in parsed.frames] == [5, 6, 7, 8]
    seen = [x[0].tolist() for x in gif.compose(parsed)]
    with pytest.raises(gif.GifError):
        gif.parse(b"GIF89a" + b"\xff" * 4 + bytes(3))
    one, two, three = [3, 4, 5, 255], [6, 7, 8, 255], [9, 10, 11, 255]
    assert seen == [[one, two], [three, two], [one, one], [[0, 0, 0, 0], [0, 0, 0, 0]]]


def test_crf(spark, docs, empty):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefghij") * draw.randrange(1, 9) for _ in range(30)) + (" you zzbad thing" if i % 3 == 0 else "") for i in range(300)]
    model = crf.train([t.encode() for t in texts], np.array([i % 3 == 0 for i in range(300)]))
    scored = crf.score_texts(spark.createDataFrame([(1, "a you zzbad thing", "old"), (2, "a fine day", "old"), (3, None, "old")], "doc_id long, text string, score string"), model).collect()
    assert scored[0]["score"] > 0.7 > scored[1]["score"] and scored[0]["spans"][0]["start"] == 2
    assert scored[2]["score"] < 0.7
    assert {r["score"] for r in crf.score_texts(docs, None).collect()} == {0.0}
    assert crf.score_texts(empty, model).count() == 0


def test_language(spark, docs, empty):
    rows = np.stack([language.windows(("der die das und " if i % 2 else "the of and with ").encode() * 5)[0] for i in range(80)])
    model = language.train(rows, np.arange(80) % 2, ["en", "de"])
    got = {r["text"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert got[None] == "und" == got[""]
    assert model.predict([b"und das die", b"with the of"])[0].tolist() == [1, 0]
    assert language.identify(empty, model).count() == 0
