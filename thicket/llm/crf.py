"""Toxicity: a linear-chain conditional random field over tokens, with two tags.

Labels come by document only, so token labels are derived first: a feature (a
word or a prefix) marks a token as toxic if documents labelled toxic hold it so
much more often than others that chance can't explain it, over all features
looked at. The field then learns weights of word, prefix and suffix features
and of tag transitions from these labelled tokens. Forward-backward gives each
token's marginal; they are aggregated to a score by a logistic fit on documents
that the field didn't see, and tokens above one half give the offending byte
offsets.

Bound of the fit: ``PER_CLASS`` documents of either label, of ``FIT_BYTES`` or
less each, and the first of them in the order of a hash up to ``FIT_TOTAL`` bytes.
The fit runs in one task; only the weights come to the driver. Scoring takes
whole texts of any length and runs on Arrow batches; chains end with sentences.

Defined results: null, empty and wordless texts get the score of a text without
evidence; without any labelled toxic document the score is 0.0 for all rows;
repeated rows are scored alike; new columns replace equally named ones; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.llm import blockwise as B
from thicket.llm import hashing as H
from thicket.llm.lineage import in_one_task

PER_CLASS = 1500
FIT_BYTES = 1 << 15
FIT_TOTAL = 10 << 20
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (3, 4)
#: Chance that any feature at all is called toxic wrongly.
ALPHA = 0.01
#: Text bytes scored together.
CHUNK = 1 << 20
EPOCHS = 6
LIMIT = 12.0

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Tokens:
    """Tokens of several texts: byte spans within their text, text number, chain number and feature hashes by kind."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    chain: np.ndarray
    features: list[np.ndarray]


def tokens(texts: list[bytes]) -> Tokens:
    buffer, bounds = H.join_texts(texts)
    word = np.zeros(len(buffer) + 1, np.int8)
    word[1:] = _WORD[buffer]
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lower = _LOWER[buffer]
    doc = np.searchsorted(bounds, start, "right") - 1
    stops = np.r_[0, np.cumsum(_END[buffer])]
    new = np.ones(len(start), bool)
    if len(start):
        new[1:] = (doc[1:] != doc[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    chain = np.cumsum(new) - 1
    kinds = [H.span_hashes(lower, start, end)]
    kinds += [H.mix(H.span_hashes(lower, start, np.minimum(start + k, end)) ^ H.U64(k)) for k in PREFIXES]
    kinds += [H.mix(H.span_hashes(lower, np.maximum(end - k, start), end) ^ H.U64(100 + k)) for k in SUFFIXES]
    return Tokens(start - bounds[doc], end - bounds[doc], doc, chain, kinds)


class Weights:
    """Feature weights by hash: keys are sorted and found by their leading bits; the full hash is compared."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = min(18, len(keys).bit_length() + 4)
        self.starts = np.searchsorted(self.keys >> H.U64(64 - self.bits), np.arange((1 << self.bits) + 1).astype(H.U64)).astype(np.int32)
        self.probes = int(np.diff(self.starts).max()) if len(keys) else 0

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.float32)
        bucket = (hashes >> H.U64(64 - self.bits)).astype(np.int64)
        low, high = self.starts[bucket], self.starts[bucket + 1]
        for probe in range(self.probes):
            at = np.flatnonzero(low + probe < high)
            if not len(at):
                break
            slot = low[at] + probe
            hit = self.keys[slot] == hashes[at]
            out[at[hit]] = self.values[slot[hit]]
        return out


def forward_backward(emission: np.ndarray, chain: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For log-odds of the toxic tag by token: marginal log-odds, forward and backward messages, and each chain's bounds.

    ``trans[i, j]`` is the weight of tag j after tag i. Chains are walked together, longest first.
    """
    heads = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]]) if len(chain) else np.empty(0, np.int64)
    size = np.diff(np.r_[heads, len(chain)])
    order = np.argsort(-size, kind="stable")
    heads, size = heads[order], size[order]
    forward, backward = emission.astype(np.float64).copy(), np.zeros(len(emission))
    longest = int(size[0]) if len(size) else 0
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]  # chains of more than t tokens
    for t in range(1, longest):
        at = heads[: alive[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(trans[0, 1], r + trans[1, 1]) - np.logaddexp(trans[0, 0], r + trans[1, 0])
    for t in range(longest - 2, -1, -1):
        at = heads[: alive[t + 1]] + t
        r = emission[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(trans[1, 0], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[0, 1] + r)
    return forward + backward, forward, backward, np.r_[heads, heads + size - 1]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: Weights
    bias: float
    trans: np.ndarray
    fit: np.ndarray  # of the document's score: constant, highest marginal, expected toxic tokens

    def marginals(self, t: Tokens) -> np.ndarray:
        emission = np.full(len(t.doc), self.bias)
        for kind in t.features:
            emission += self.weights.of(kind)
        return forward_backward(emission, t.chain, self.trans)[0]

    def evidence(self, t: Tokens, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """A row of aggregates for each document, and the token marginals."""
        logits = np.clip(self.marginals(t), -LIMIT, LIMIT)
        top, expected = np.full(docs, -LIMIT), np.zeros(docs)
        np.maximum.at(top, t.doc, logits)
        np.add.at(expected, t.doc, _sigmoid(logits) * (logits > 0))
        return np.stack([np.ones(docs), top, np.log1p(expected)], axis=1), logits

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return _sigmoid(evidence @ self.fit)


def _distinct(texts: list[bytes]) -> list[int]:
    """Indices of texts that aren't near copies of an earlier one, by bands of minimum hashes."""
    t, seen, out = tokens(texts), set(), []
    first = np.searchsorted(t.doc, np.arange(len(texts) + 1))
    pairs = H.windows(t.features[0], 3)
    for i in range(len(texts)):
        own = pairs[first[i] : max(first[i], first[i + 1] - 2)]
        if len(own):
            least = [int(H.mix(own ^ H.U64(0x51ED * s)).min()) for s in range(12)]
            bands = {(b, *least[2 * b : 2 * b + 2]) for b in range(6)}
            if seen & bands:
                continue
            seen |= bands
        out.append(i)
    return out


def token_labels(t: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents that hold a feature which toxic documents have beyond chance."""
    share, found, looked_at = toxic.mean(), [], 0
    for kind in t.features[: 1 + len(PREFIXES)]:
        once = np.unique(H.mix(kind) ^ H.mix(t.doc.astype(H.U64)), return_index=True)[1]  # a feature counts once a document
        keys, inverse = np.unique(kind[once], return_inverse=True)
        found.append((kind, keys, np.bincount(inverse), np.bincount(inverse, toxic[t.doc[once]])))
        looked_at += len(keys)
    mark = np.zeros(len(t.doc), bool)
    for kind, keys, n, a in found:
        p = np.clip(a / n, 1e-9, 1 - 1e-9)
        surprise = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
        rare = (n - a) / (~toxic).sum() * toxic.sum() <= 0.05 * a
        chosen = keys[(p > share) & rare & (surprise > np.log(max(2, looked_at) / ALPHA))]
        if len(chosen):
            mark |= np.isin(kind, chosen)
    return mark & toxic[t.doc]


def train(texts: list[bytes], toxic: np.ndarray) -> Model | None:
    """The model of labelled documents; None if there's nothing to tell labels apart by."""
    keep = _distinct(texts)
    texts, toxic = [texts[i] for i in keep], toxic[keep].astype(bool)
    if not toxic.any() or toxic.all():
        return None
    t = tokens(texts)
    label = token_labels(t, toxic).astype(float)
    fold = np.arange(len(texts)) % 4 == 3
    # only features that some toxic token has can tell tags apart; the bias stands for all others, whose slot is the last
    keys = np.unique(np.concatenate([kind[label > 0] for kind in t.features]))
    index = np.stack([np.searchsorted(keys, kind).astype(np.int32) for kind in t.features])
    for row, kind in zip(index, t.features, strict=True):
        row[~B.is_among(kind, keys)] = len(keys)
        row[row > len(keys)] = len(keys)
    useful = np.r_[np.ones(len(keys)), 0.0]
    w, bias, trans = np.zeros(len(useful)), -2.0, np.zeros((2, 2))
    square_w, square_b, square_t = np.full(len(useful), 1e-2), 1e-2, np.full((2, 2), 1e-2)
    hot = np.unique(t.chain[label > 0])
    held = fold[t.doc]
    rng = np.random.Generator(np.random.PCG64(7))
    chains = np.unique(t.chain[~held])
    for _ in range(EPOCHS):
        chosen = np.isin(t.chain, np.r_[hot, rng.choice(chains, min(len(chains), max(2000, 8 * len(hot))), replace=False)]) & ~held if len(chains) else np.zeros(len(held), bool)
        rows = np.flatnonzero(chosen)
        parts = np.array_split(np.unique(t.chain[rows]), 16)
        for part in parts:
            if not len(part):
                continue
            at = rows[np.searchsorted(part, t.chain[rows]) < len(part)]
            at = at[part[np.minimum(np.searchsorted(part, t.chain[at]), len(part) - 1)] == t.chain[at]]
            ids, y, chain = index[:, at], label[at], t.chain[at]
            emission = bias + (w[ids]).sum(axis=0)
            logits, forward, backward, _ = forward_backward(emission, chain, trans)
            error = _sigmoid(logits) - y
            grad = sum(np.bincount(row, error, len(useful)) for row in ids)
            grad = (grad / 32 + 1e-4 * w) * useful
            square_w += grad**2
            w -= 0.5 * grad / np.sqrt(square_w)
            g = error.sum() / 32
            square_b += g * g
            bias -= 0.3 * g / np.sqrt(square_b)
            pair = np.flatnonzero(chain[1:] == chain[:-1])
            if len(pair):
                r, s = forward[pair], emission[pair + 1] + backward[pair + 1]
                joint = np.stack([trans[i, j] + i * r + j * s for i in (0, 1) for j in (0, 1)])
                joint = np.exp(joint - joint.max(axis=0))
                joint /= joint.sum(axis=0)
                seen = np.bincount((2 * y[pair] + y[pair + 1]).astype(int), minlength=4)
                gt = ((joint.sum(axis=1) - seen) / 32).reshape(2, 2)
                square_t += gt**2
                trans -= 0.3 * gt / np.sqrt(square_t)
    strong = np.abs(w[:-1]) > 0.02
    model = Model(Weights(keys[strong], w[:-1][strong]), float(bias), trans, np.zeros(3))
    if not (fold & toxic).any():
        fold = np.ones(len(texts), bool)
    evidence, _ = model.evidence(t, len(texts))
    x, y = evidence[fold], toxic[fold].astype(float)
    fit = np.array([0.0, 0.5, 0.5])
    for _ in range(50):  # Newton steps of a ridge-penalised logistic fit around a positive prior
        p = _sigmoid(x @ fit)
        slope = x.T @ (p - y) + 0.5 * (fit - np.array([0.0, 0.5, 0.5]))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        fit = fit - np.linalg.solve(curve, slope)
    model.fit = fit
    return model


def fit_from(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """Fit on a bounded sample, drawn by a hash of the id, of the rows of ``labels`` for which ``allowed`` (an expression over ``id_col``) holds."""
    known = labels.filter(allowed & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    part = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(F.lit(min(1.0, per_class / counts[0])))
    chosen = known.filter(draw < part * (1 << 30)).limit(3 * per_class)
    small = docs.filter(F.octet_length(text) <= FIT_BYTES).select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    rows = chosen.join(small, "id").orderBy(F.xxhash64("id", F.lit(5)), "id", "body", "y").limit(3 * per_class).select("body", "y")

    def fit(batches):
        texts, marks, left = [], [], FIT_TOTAL
        for batch in batches:
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left -= len(body)
                if left >= 0:
                    texts.append(body.encode())
                    marks.append(y)
        return train(texts, np.array(marks, bool)) if texts else None

    return in_one_task(rows, fit)


def _spans(t: Tokens, logits: np.ndarray, docs: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(docs)]
    for i in np.flatnonzero(logits > 0):
        spans, start, end = out[t.doc[i]], int(t.start[i]), int(t.end[i])
        if spans and i and t.doc[i - 1] == t.doc[i] and logits[i - 1] > 0 and t.chain[i - 1] == t.chain[i]:
            spans[-1]["end"] = end
        else:
            spans.append({"start": start, "end": end})
    return out


def score_texts(frame: DataFrame, model: Model | None, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """Add ``score`` (0 to 1) and ``spans`` (byte offsets of toxic stretches) to every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in frame.columns if c not in (score, spans)]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(score, T.DoubleType()), T.StructField(spans, T.ArrayType(span))])

    def scored(texts):
        if model is None:
            return np.zeros(len(texts)), [[] for _ in texts]
        t = tokens(texts)
        evidence, logits = model.evidence(t, len(texts))
        return model.score(evidence), _spans(t, logits, len(texts))

    def run(batches):
        target = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.string()).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < CHUNK):
                    size += len(texts[to] or b"")
                    to += 1
                found, where = scored([x or b"" for x in texts[at:to]])
                part = batch.slice(at, to - at)
                columns = [part.column(part.schema.get_field_index(c)).cast(target.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64()), pa.array(where, target.field(spans).type)], schema=target)
                at = to

    return frame.mapInArrow(run, schema)
