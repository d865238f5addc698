"""Language identification with a small convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes (the last one padded with blanks).
Each window goes through byte embeddings, filters of several widths, a rectifier,
max pooling over positions and a softmax. The network is trained in numpy with
Adam on labelled windows. For prediction, embedding and filters are folded into
one lookup table for each offset, so a convolution is a sum of table rows. The
log-probabilities of all windows of the whole text are averaged.

Bound of the fit: about ``PER_LANGUAGE`` documents of each label, and fewer where
there are so many labels that ``SAMPLE`` documents wouldn't do, drawn by a hash of
the id; ``PER_TEXT`` windows of each. More than ``LABELS`` different labels are an
error. The fit runs in one task; only the weights come to the driver.

Defined results: ``und`` and score 0.0 for null texts and texts without a letter,
and for all texts if there was nothing to learn from; repeated rows get equal
results; new columns replace equally named ones; an empty table gives an empty
table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.llm.lineage import in_one_task

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
PER_LANGUAGE = 400
SAMPLE = 80_000
LABELS = 20_000
PER_TEXT = 6
EPOCHS = 8
BATCH = 64
#: Text bytes predicted together.
CHUNK = 1 << 19
#: What a text of unknown language gets.
UNKNOWN = "und"


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, one a row."""
    rows = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(rows * WINDOW, b" "), np.uint8).reshape(rows, WINDOW)


@dataclass
class Model:
    labels: list[str]
    tables: list[np.ndarray]  # by offset: a row for each byte, filters of greater widths first
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        n, width = rows.shape
        out = self.tables[0][rows]
        for offset, table in enumerate(self.tables[1:], 1):
            out[:, : width - offset, : table.shape[1]] += table[rows[:, offset:]]
        pooled, at = [], 0
        for size in sorted(WIDTHS, reverse=True):
            pooled.append(out[:, : width - size + 1, at : at + FILTERS].max(axis=1))
            at += FILTERS
        z = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.dense + self.dense_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the label and its probability for each text."""
        parts = [windows(x) for x in texts]
        rows = np.concatenate(parts)
        logs = np.concatenate([self.log_probabilities(rows[i : i + 512]) for i in range(0, len(rows), 512)])
        heads = np.r_[0, np.cumsum([len(x) for x in parts])[:-1]]
        mean = np.add.reduceat(logs, heads) / np.array([len(x) for x in parts])[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1).astype(float)


def train(rows: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 11) -> Model:
    """Fit the network to windows and their label numbers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = sorted(WIDTHS, reverse=True)
    weights = {"embed": rng.normal(0, 0.5, (256, EMBEDDING))}
    weights |= {f"w{k}": rng.normal(0, 1 / np.sqrt(k * EMBEDDING), (k * EMBEDDING, FILTERS)) for k in order}
    weights |= {"bias": np.zeros(len(order) * FILTERS), "dense": rng.normal(0, 0.2, (len(order) * FILTERS, len(names))), "dense_bias": np.zeros(len(names))}
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            x, y, step = rows[part], labels[part], step + 1
            embedded, pooled, best = weights["embed"][x], [], []
            for k in order:
                n = x.shape[1] - k + 1
                seen = np.concatenate([embedded[:, i : i + n] for i in range(k)], axis=2)
                out = seen @ weights[f"w{k}"]
                best.append(out.argmax(axis=1))
                pooled.append(out.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + weights["bias"], 0)
            z = hidden @ weights["dense"] + weights["dense_bias"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ weights["dense"].T) * (hidden > 0)
            grads = {"dense": hidden.T @ p, "dense_bias": p.sum(axis=0), "bias": back.sum(axis=0), "embed": np.zeros_like(weights["embed"])}
            for i, k in enumerate(order):
                own, where = back[:, i * FILTERS : (i + 1) * FILTERS], best[i]
                reach = where[:, :, None] + np.arange(k)  # text, filter, offset
                bytes_at = x[np.arange(len(y))[:, None, None], reach]
                seen = weights["embed"][bytes_at].reshape(len(y), FILTERS, k * EMBEDDING)
                grads[f"w{k}"] = np.einsum("bf,bfd->df", own, seen)
                down = (own[:, :, None] * weights[f"w{k}"].T).reshape(-1, EMBEDDING)
                np.add.at(grads["embed"], bytes_at.ravel(), down)
            for name, grad in grads.items():
                first, second = moments[name]
                first += 0.1 * (grad - first)
                second += 0.01 * (grad**2 - second)
                weights[name] -= 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    tables = []
    for offset in range(max(order)):
        tables.append(np.concatenate([weights["embed"] @ weights[f"w{k}"][offset * EMBEDDING : (offset + 1) * EMBEDDING] for k in order if k > offset], axis=1).astype(np.float32))
    return Model(names, tables, weights["bias"], weights["dense"], weights["dense_bias"])


def fit_from(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """Fit on a bounded sample of the rows with a label and a text for which ``allowed`` holds."""
    known = docs.filter(allowed & F.col(label).isNotNull() & (F.octet_length(text) > 0))
    counts = known.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"))
    names = sorted(r["y"] for r in counts.limit(LABELS + 1).collect())
    if len(names) > LABELS:
        raise ValueError(f"more than {LABELS} languages")
    if not names:
        return None
    # at most LABELS rows, as counted
    share = F.broadcast(counts.select(F.col("y").alias("label"), F.least(F.lit(1.0), F.lit(min(PER_LANGUAGE, max(1, SAMPLE // len(names)))) / F.col("n")).alias("share")))
    drawn = known.select(F.col(label).alias("y"), F.col(id_col).alias("id"), F.col(text).alias("body")).join(share, F.col("y") == F.col("label"))
    drawn = drawn.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    # windows are cut by characters here: only their bytes are kept, and only these few
    at = F.array(*(F.substring("body", (F.pmod(F.xxhash64("id", F.lit(i)), F.greatest(F.lit(1), F.length("body") - WINDOW)) + 1).cast("int"), WINDOW) for i in range(PER_TEXT)))
    sample = drawn.select("y", "id", at.alias("parts")).orderBy("id", "y", "parts").limit(3 * min(SAMPLE, PER_LANGUAGE * len(names))).select("y", "parts")

    def fit(batches):
        index, rows = {name: i for i, name in enumerate(names)}, []
        for batch in batches:
            for y, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(windows(part.encode())[0], index[y]) for part in dict.fromkeys(parts)]
        return train(np.stack([x for x, _ in rows]), np.array([y for _, y in rows]), names) if rows else None

    return in_one_task(sample, fit)


def identify(frame: DataFrame, model: Model | None, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted label and its probability to every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in frame.columns if c not in (label, score)]
    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        target = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.string()).to_pylist()
            names, scores, at = [UNKNOWN] * len(texts), [0.0] * len(texts), 0
            while at < len(texts):
                to, size, known = at, 0, []
                while to < len(texts) and (to == at or size < CHUNK):
                    x = texts[to]
                    if model is not None and x and any(map(str.isalpha, x)):
                        known.append(to)
                        size += len(x)
                    to += 1
                if known:
                    for i, best, p in zip(known, *model.predict([texts[i].encode() for i in known]), strict=True):
                        names[i], scores[i] = model.labels[best], float(p)
                at = to
            columns = [batch.column(batch.schema.get_field_index(c)).cast(target.field(c).type) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names), pa.array(scores, pa.float64())], schema=target)

    return frame.mapInArrow(run, schema)
