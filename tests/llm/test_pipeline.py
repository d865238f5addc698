"""The pipeline's stages on a small corpus: columns, what goes and what stays."""

import hashlib

import pytest

import corpus_pipeline

BAD = "zzvile"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    import random

    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    shared = text(30)
    rows = []
    for i in range(120):
        body = text(60) + (f" {BAD} {BAD}" if i % 4 == 0 else "")
        rows.append((i, f"{body}\n{shared}" if i % 10 == 1 else body, "en", f"s{i % 3}"))
    rows.append((200, rows[2][1], "en", "s2"))
    rows.append((201, None, None, None))
    rows.append((202, "", "en", "s1"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i in range(120) if i % 4} | {200, 201, 202}

    lines = stages["line_dedup"](spark, clean, folder).cache()
    assert lines.columns == columns and lines.count() == clean.count()
    kept = {r["doc_id"]: r for r in lines.collect()}
    assert kept[200]["text"] == "" and kept[200]["n_chars"] == 0 and kept[2]["text"] and kept[201]["text"] is None
    assert "\n" in kept[1]["text"] and "\n" not in kept[11]["text"]

    one = stages["simhash_near_dedup"](spark, lines, folder).cache()
    assert one.columns == columns
    # the emptied copy, the null and the empty text are one group
    assert {200, 201, 202} & {r["doc_id"] for r in one.collect()} == {200}

    mixed = stages["mixing"](spark, one, folder).cache()
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in one.collect()}

    encoded = stages["byte_bpe"](spark, mixed, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in mixed.collect()}
    assert len(encoded) == mixed.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in encoded)
