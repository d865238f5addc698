"""Near copies against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
from thicket.llm import near_copies


def texts():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(30):
        base = draw.choices(vocabulary, k=draw.randrange(60, 240))
        rows.append(" ".join(base))
        for share in (0.01, 0.02, 0.04, 0.08):
            rows.append(" ".join(draw.choice(vocabulary) if draw.random() < share else w for w in base))
    # one large group
    base = draw.choices(vocabulary, k=200)
    for _ in range(60):
        copy = list(base)
        for _ in range(3):
            copy[draw.randrange(200)] = draw.choice(vocabulary)
        rows.append(" ".join(copy))
    draw.shuffle(rows)
    return [*rows, None, "", "two words", "Two  WORDS"]


def test_same_as_all_pairs(spark):
    rows = texts()
    sets = [set(near_copies.shingle_set(t).tolist()) for t in rows]
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


def test_few_alike_sets_share_no_key():
    draw = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        both, a, b = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (160, 20, 20))
        missed += not set(near_copies.band_keys(np.r_[both, a])) & set(near_copies.band_keys(np.r_[both, b]))
    assert missed <= 3
