"""Quality by attention-based multiple-instance learning: a document is a bag of passages with one label.

Every passage (a fixed number of bytes; all of the text is in one) is described
by hashed counts of byte pairs, shares of character classes, and how much its
words repeat (a word that a passage's edge divides counts in parts).  An encoder
turns it into a vector h; gated attention gives it the
weight softmax(w . (tanh(V h) * sigmoid(U h))) among the document's passages;
the weighted sum of the vectors is scored by a logistic layer.  All parts are
trained together by Adam from document labels alone, on a bounded sample of
labelled rows, so the attention learns by itself which passages tell. The scores
are calibrated to the classes' shares among all labelled rows. A long text is read
in parts whose weighted sums are merged, so memory does not grow with its length.

The sample has at most about `sample_rows` whole texts and `sample_bytes` bytes.
Rows whose label, id or text is null, and ids with both labels, are not learned from.
With labels of one class only, or none, every score is that class's share (0 without labels).
A null or empty text is one passage without bytes and gets a score like any other.
Repeated rows are scored each for itself; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm import common, samples
from lakepress.llm.bytesops import Words, groups, mix64, pieces
from lakepress.llm.toxicity import calibrated

PASSAGE = 256
BINS = 160
HIDDEN, GATE = 32, 16
SAMPLE_ROWS, SAMPLE_BYTES = 5_000, 64 << 20
#: Bytes that are described at once.
PART = 1 << 20
#: Passes over the sample; a small sample gets more, for about as many steps.
EPOCHS, MOST_EPOCHS, FEW_ROWS = 5, 40, 4_000
FOLD, HELD_OUT = 5, 0

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[[9, 10, 13]], _CLASS[128:] = 1, 2, 3, 4, 5, 6
for _k, _c in enumerate((33, 35, 36, 37, 38, 42, 44, 46, 124)):
    _CLASS[_c] = 7 + _k
_CLASSES = 16
_PAIR_BIN = (mix64(np.arange(65536, dtype=np.uint64) + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)
#: Numbers that describe a passage.
WIDTH = BINS + _CLASSES + 7


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts (n x WIDTH), and where each text's begin (texts + 1 places); an empty text has one."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = int(first[-1])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    passage = first[owner] + (np.arange(len(data)) - offsets[owner]) // PASSAGE
    size = np.maximum(np.bincount(passage, minlength=n), 1).astype(np.float32)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out, first
    pair = _PAIR_BIN[data[:-1].astype(np.int64) * 256 + data[1:]]
    same = passage[1:] == passage[:-1]
    found = np.bincount(passage[:-1][same] * BINS + pair[same], minlength=n * BINS).reshape(n, BINS)
    out[:, :BINS] = np.sqrt(found / size[:, None])
    found = np.bincount(passage * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    out[:, BINS : BINS + _CLASSES] = found / size[:, None]
    nth = np.arange(n) - np.repeat(first[:-1], counts)
    edges = np.append(np.repeat(offsets[:-1], counts) + nth * PASSAGE, len(data))
    words = Words(data, edges)
    if len(words.starts):
        h, of = words.hashes, np.repeat(np.arange(n), np.diff(words.first))
        have = np.bincount(of, minlength=n).astype(np.float32)
        total = np.maximum(have, 1)
        at = BINS + _CLASSES
        out[:, at] = have / size * 4
        out[:, at + 1] = np.bincount(of, weights=words.ends - words.starts, minlength=n) / total / 8
        for lag in (1, 2, 3):
            equal = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
            out[:, at + 1 + lag] = np.bincount(of[lag:][equal], minlength=n) / total
        key = (of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        key.sort()
        new = np.ones(len(h), bool)
        new[1:] = key[1:] != key[:-1]
        out[:, at + 5] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n) / total
    out[:, BINS + _CLASSES + 6] = np.bincount(passage, minlength=n) / PASSAGE
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Scaling of the description, encoder, gated attention, logistic layer, and calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    slope: float = 1.0
    intercept: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """Calibrated logits of texts. What attention has summed up so far (under the largest exponent) is merged with the next part of a text."""
        most, total, z = np.full(len(column), -np.inf), np.zeros(len(column)), np.zeros((len(column), HIDDEN))
        for rows, data, offsets in pieces(column, PART, PASSAGE):
            described, first = describe(data, offsets)
            h, _, _, e = self._encoded((described - self.mean) / self.spread)
            m = np.maximum.reduceat(e, first[:-1])
            a = np.exp(e - np.repeat(m, np.diff(first)))
            new = np.maximum(most[rows], m)
            old, own = np.exp(most[rows] - new), np.exp(m - new)
            total[rows] = total[rows] * old + np.add.reduceat(a, first[:-1]) * own
            z[rows] = z[rows] * old[:, None] + np.add.reduceat(a[:, None] * h, first[:-1]) * own[:, None]
            most[rows] = new
        return self.slope * ((z / np.maximum(total, 1e-30)[:, None]) @ self.weights[5] + self.weights[6][0]) + self.intercept

    def _encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of passages, both halves of the gate, and attention before the softmax."""
        enc, enc_b, v, u, w, _, _ = self.weights
        h = np.tanh(x @ enc + enc_b)
        t, s = np.tanh(h @ v), _sigmoid(h @ u)
        return h, t, s, (t * s) @ w

    def _bags(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        c, d = self.weights[5:]
        h, t, s, e = self._encoded(x)
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return h, t, s, a, z, z @ c + d[0]


def train(texts: list[str], labels: np.ndarray, share: float, epochs: int | None = None, seed: int = 3) -> Model:
    """Train all parts on texts and their labels; `share` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    shapes = [(WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    weights = [(rng.normal(0, 1 / math.sqrt(s[0]), s) if k not in (1, 6) else np.zeros(s)).astype(np.float32) for k, s in enumerate(shapes)]
    model = Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), weights)
    if len(set(np.asarray(labels).tolist())) < 2:
        model.slope, model.intercept = 0.0, math.log((share + 1e-9) / (1 - share + 1e-9))
        return model
    parts, places, last = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in groups(pa.array(texts, pa.large_string())):
        described, first = describe(data, offsets)
        parts.append(described.astype(np.float16))
        places.append(first[1:] + last)
        last += len(described)
    described, first = np.concatenate(parts), np.concatenate(places)
    del parts
    some = described[rng.permutation(len(described))[:20_000]].astype(np.float32)
    model.mean, model.spread = some.mean(0), some.std(0) + 0.02
    y = np.asarray(labels, np.float32)
    m1, m2 = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    step, batch = 0, 64
    epochs = epochs or min(MOST_EPOCHS, max(EPOCHS, EPOCHS * FEW_ROWS // len(y)))
    total = epochs * math.ceil(len(y) / batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = first[pick + 1] - first[pick]
            bag = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(bag[-1]) + np.repeat(first[pick] - bag[:-1], sizes)
            x = (described[rows].astype(np.float32) - model.mean) / model.spread
            enc, _, v, u, w, c, _ = weights
            h, t, s, a, z, logit = model._bags(x, bag)
            g = (_sigmoid(logit) - y[pick]) / len(pick)
            dz = np.repeat(g, sizes)[:, None] * c
            dh = a[:, None] * dz
            da = (h * dz).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, bag[:-1]), sizes))
            gate = de[:, None] * w
            dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
            dh = (dh + dt @ v.T + ds @ u.T) * (1 - h * h)
            grads = [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ g, np.array([g.sum()])]
            step += 1
            rate = 0.004 * (1 - 0.95 * step / total)
            for k, grad in enumerate(grads):
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.01 * (grad * grad - m2[k])
                if k in (0, 5):
                    weights[k] *= 1 - rate * 0.05
                weights[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    z = np.concatenate([model._bags((described[first[k] : first[min(k + 256, len(y))]].astype(np.float32) - model.mean) / model.spread, first[k : min(k + 256, len(y)) + 1] - first[k])[-1] for k in range(0, len(y), 256)])
    model.slope, model.intercept = calibrated(z, y, share)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, held_out: int = HELD_OUT) -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold."""
    common.small_batches(docs.sparkSession)
    return samples.fitted(docs, labels, label, sample_rows, sample_bytes, FOLD, held_out, train)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; no exchange."""
    common.small_batches(docs.sparkSession)
    sent = common.send(docs.sparkSession, model)
    rows = common.texts(docs).withColumn("held_out", common.fold(F.col("doc_id"), FOLD) == held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(_sigmoid(sent.value.logits(batch.column(1)).astype(np.float64)), 6)  # equal texts in other batches differ in the last bits
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(common.trimmed(run), SCHEMA)
