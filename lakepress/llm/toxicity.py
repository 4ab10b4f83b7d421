"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are itself and the byte n-grams of its lower-cased form
between marks, hashed into buckets; each bucket has a vector.  A word is the
mean of its features' vectors, a text the scaled mean of its
distinct words, weighted by the root of their counts (a repeated word does not drown the others), and a linear
softmax over two classes reads the text.  Vectors and softmax are trained
together by Adam on a bounded sample of labelled rows; an unseen misspelling
shares most n-grams with the word it stands for.

All of it is linear up to the softmax, so for scoring each bucket's vector is
multiplied by the softmax weights once, which leaves a number for each bucket.
A worker keeps the number of each distinct word.  All words of the whole text
count, however long it is; a long one is read in parts (a word of more than PART
bytes counts in parts too).

The sample has at most about `sample_rows` whole texts of `sample_bytes` bytes outside the held-out fold, as
many of either class as there are up to a half, chosen by the hash of the id;
the intercept is then shifted to the classes' true odds among all labelled rows.
Rows whose label, id or text is null, and ids with both labels, are not learned from. With
labels of one class only, or none, every score is that class's share (0 without labels).
A null or empty text has no words and gets the score of the intercept. Repeated
rows are scored each for itself; score() reads no other columns and clean() keeps them as they
are; an empty table gives an empty result.
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
from lakepress.llm.bytesops import HashIndex, Words, groups, mix64, word_pieces

BUCKETS = 1 << 17
DIMENSIONS = 4
NGRAMS = (3, 4, 5)
SCALE = 64.0
SAMPLE_ROWS, SAMPLE_BYTES = 9_000, 64 << 20
#: Passes over the sample; a small sample gets more, up to MOST_EPOCHS, for about as many steps.
EPOCHS, MOST_EPOCHS, FEW_ROWS = 4, 24, 6_000
#: Lengths of the runs of words that each clean text adds to training.
SHORT = (1, 2, 6)
#: A bucket that fewer documents of the sample have stays at zero: it can only be learned by heart. The same for samples of any size.
MIN_DOCS = 3
RATE, DECAY = 0.03, 0.05
FOLD, HELD_OUT = 5, 0
#: Distinct words that a worker keeps; beyond it the table begins anew. It bounds memory, not results.
KEPT_WORDS = 1 << 20
#: A longer text is read in parts of so many bytes.
PART = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 13

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of words, and the first of each word's (n + 1 places); the word itself comes first. Some words at a time, to spare memory."""
    if len(starts) > _AT_ONCE:
        parts = [features(low, starts[k : k + _AT_ONCE], ends[k : k + _AT_ONCE], hashes[k : k + _AT_ONCE], buckets) for k in range(0, len(starts), _AT_ONCE)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in parts]))])
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.empty(at[-1], np.uint8)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    marked[at[:-1]], marked[at[1:] - 1] = 60, 62
    marked[inner] = low[np.arange(int((sizes - 2).sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes - 2)[:-1]]), sizes - 2)]
    owner = np.repeat(np.arange(len(starts)), sizes)
    left = at[1:][owner] - np.arange(at[-1])  # bytes from here to the word's end
    owners, found = [np.arange(len(starts))], [hashes]
    wide = marked.astype(np.uint64)
    for n in NGRAMS:
        ok = np.flatnonzero(left >= n)
        h = np.full(len(ok), n, np.uint64)
        for k in range(n):
            h = h * _MIX + wide[ok + k] + np.uint64(1)
        owners.append(owner[ok])
        found.append(mix64(h))
    all_owners, all_found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(all_owners, kind="stable")
    ids = (all_found[order] >> np.uint64(64 - int(math.log2(buckets)))).astype(np.int32)
    return ids, np.searchsorted(all_owners[order], np.arange(len(starts) + 1))


@dataclass
class Model:
    """What scoring needs: a number for each bucket, scale and intercept."""

    weights: np.ndarray
    intercept: float

    def words(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word: the mean of its features'."""
        if not len(starts):
            return np.zeros(0)
        ids, at = features(low, starts, ends, hashes, len(self.weights))
        return np.add.reduceat(self.weights[ids].astype(np.float64), at[:-1]) / np.diff(at)


class Scorer:
    """Scores batches of texts; keeps the numbers of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index, self.values, self.hashes = HashIndex(16), np.zeros(0), np.zeros(0, np.uint64)

    def _counted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, row in the table, and count of each text's distinct words."""
        words = Words(data, offsets)
        rows = self.index.lookup(words.hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, where = np.unique(words.hashes[missing], return_index=True)
            if self.index.size + len(new) > KEPT_WORDS:
                self._clear()
                new, where = np.unique(words.hashes, return_index=True)
            else:
                where = missing[where]
            self.index.insert(new)
            self.hashes = np.concatenate([self.hashes, new])
            self.values = np.concatenate([self.values, self.model.words(words.low, words.starts[where], words.ends[where], new)])
            rows = self.index.lookup(words.hashes)
        key = (np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(words.first)) << 32) | rows
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[at] >> 32, key[at] & 0xFFFFFFFF, np.diff(np.append(at, len(key)))

    def _one(self, data: np.ndarray) -> float:
        """The mean of a long text's words."""
        hashes, counts, values = [], [], []
        for part in word_pieces(data, PART):
            _, word, count = self._counted(part, np.array([0, len(part)]))
            hashes.append(self.hashes[word])
            counts.append(count)
            values.append(self.values[word])
        if not hashes:
            return 0.0
        _, first, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        weight = np.sqrt(np.bincount(of, weights=np.concatenate(counts)))
        return float((weight * np.concatenate(values)[first]).sum() / max(weight.sum(), 1e-30)) if len(first) else 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """The logits of whole texts."""
        out = [np.zeros(0)]
        for i, j, data, offsets in groups(column):
            if j - i == 1 and len(data) > PART:
                means = np.array([self._one(data)])
            else:
                text, word, count = self._counted(data, offsets)
                weight = np.sqrt(count)
                total = np.bincount(text, weights=weight * self.values[word], minlength=j - i)
                means = total / np.maximum(np.bincount(text, weights=weight, minlength=j - i), 1)
            out.append(SCALE * means + self.model.intercept)
        return np.concatenate(out)


def train(texts: list[str], labels: np.ndarray, share: float, epochs: int | None = None, seed: int = 7) -> Model:
    """Train vectors and softmax jointly; `share` is the share of class 1 among all labelled rows."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        odds = math.log((share + 1e-9) / (1 - share + 1e-9))
        return Model(np.zeros(BUCKETS, np.float32), odds)
    rng = np.random.default_rng(seed)
    doc_words, doc_counts, ids, at = [], [], [], [np.zeros(1, np.int64)]
    index, last = HashIndex(16), 0
    classes: list[int] = []
    extra: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, data, offsets in groups(pa.array(texts, pa.large_string())):
        words = Words(data, offsets)
        rows = index.lookup(words.hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, where = np.unique(words.hashes[missing], return_index=True)
            index.insert(new)
            where = missing[where]
            got, places = features(words.low, words.starts[where], words.ends[where], new)
            ids.append(got)
            at.append(places[1:] + last)
            last += len(got)
            rows = index.lookup(words.hashes)
        for a, b in zip(words.first[:-1], words.first[1:]):
            unique, count = np.unique(rows[a:b], return_counts=True)
            doc_words.append(unique.astype(np.int32))
            doc_counts.append((np.sqrt(count) / np.sqrt(count).sum()).astype(np.float32))
            if not labels[len(classes)] and b > a:  # any run of words of a clean text is clean: short ones keep single words near zero
                for n in SHORT:
                    i = int(rng.integers(a, max(a + 1, b - n + 1)))
                    unique, count = np.unique(rows[i : min(b, i + n)], return_counts=True)
                    extra.append((unique.astype(np.int32), (np.sqrt(count) / np.sqrt(count).sum()).astype(np.float32)))
            classes.append(labels[len(classes)])
    feature_ids, places = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(at)
    del ids, at, index

    mine = float(labels.mean())
    doc_words += [x for x, _ in extra]
    doc_counts += [x for _, x in extra]
    labels = np.concatenate([labels, np.zeros(len(extra), np.int64)])
    in_docs = np.bincount(np.concatenate(doc_words), minlength=len(places) - 1)
    seen = np.zeros(BUCKETS)
    for k in range(0, len(in_docs), _AT_ONCE):
        to = min(k + _AT_ONCE, len(in_docs))
        seen += np.bincount(feature_ids[places[k] : places[to]], weights=np.repeat(in_docs[k:to], np.diff(places[k : to + 1])), minlength=BUCKETS)
    rare = (seen < MIN_DOCS)[:, None]
    epochs = epochs or min(MOST_EPOCHS, max(EPOCHS, EPOCHS * FEW_ROWS // max(1, len(classes))))

    vectors = rng.normal(0, 0.002, (BUCKETS, DIMENSIONS)).astype(np.float32)
    vectors[rare[:, 0]] = 0
    softmax = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, softmax, bias)]
    step, batch = 0, 128
    total = epochs * math.ceil(len(labels) / batch)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), batch):
            docs = [k for k in order[s : s + batch] if len(doc_words[k])]
            if not docs:
                continue
            sizes = np.array([len(doc_words[k]) for k in docs])
            used, word = np.unique(np.concatenate([doc_words[k] for k in docs]), return_inverse=True)
            share_of = np.concatenate([doc_counts[k] for k in docs])
            row = np.repeat(np.arange(len(docs)), sizes)
            n = places[used + 1] - places[used]
            first = np.concatenate([[0], np.cumsum(n)])
            take = feature_ids[np.arange(first[-1]) + np.repeat(places[used] - first[:-1], n)]
            word_vectors = np.add.reduceat(vectors[take], first[:-1]) / n[:, None].astype(np.float32)
            bag = SCALE * np.add.reduceat(word_vectors[word] * share_of[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            z = bag @ softmax + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            p /= len(docs)
            to_bag = (p @ softmax.T) * SCALE
            to_word = np.zeros((len(used), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                to_word[:, d] = np.bincount(word, weights=to_bag[row, d] * share_of, minlength=len(used))
            to_feature = np.repeat(to_word / n[:, None], n, axis=0)
            to_feature[rare[take, 0]] = 0
            touched = np.flatnonzero(np.bincount(take, minlength=BUCKETS))
            grad = np.stack([np.bincount(take, weights=to_feature[:, d], minlength=BUCKETS)[touched] for d in range(DIMENSIONS)], 1).astype(np.float32)
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for (m, v), x, g, rows in ((state[0], vectors, grad, touched), (state[1], softmax, bag.T @ p, slice(None)), (state[2], bias, p.sum(0), slice(None))):
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.99 * v[rows] + 0.01 * g * g
                if x is vectors:
                    x[rows] *= 1 - rate * DECAY
                x[rows] -= rate * (m[rows] / (1 - 0.9 ** min(step, 200))) / (np.sqrt(v[rows] / (1 - 0.99 ** min(step, 2000))) + 1e-6)
    own = vectors @ (softmax[:, 1] - softmax[:, 0])
    word_value = np.concatenate([np.add.reduceat(own[feature_ids[places[k] : places[k + _AT_ONCE] if k + _AT_ONCE < len(places) else None]], places[k : min(k + _AT_ONCE, len(places) - 1)] - places[k]) for k in range(0, len(places) - 1, _AT_ONCE)]) / np.diff(places)
    z = np.array([SCALE * float(word_value[w] @ c) for w, c in zip(doc_words[: len(classes)], doc_counts)])
    slope, intercept = calibrated(z, np.asarray(classes), share)
    return Model((own * slope).astype(np.float32), intercept)


def calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over logits, the classes weighted as among all labelled rows."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    middle, spread = z.mean(), z.std() + 1e-9
    x = np.stack([(z - middle) / spread, np.ones(len(z))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slack = np.diag([1e-3 * len(z), 0])
        w = w - np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + slack + 1e-9 * np.eye(2), x.T @ (weight * (p - y)) + slack @ w)
    return max(float(w[0] / spread), 1e-6), float(w[1] - w[0] * middle / spread)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, held_out: int = HELD_OUT) -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold."""
    common.small_batches(docs.sparkSession)
    return samples.fitted(docs, labels, label, sample_rows, sample_bytes, FOLD, held_out, train)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; no exchange."""
    common.small_batches(docs.sparkSession)
    sent = common.send(docs.sparkSession, model)
    rows = common.texts(docs).withColumn("held_out", common.fold(F.col("doc_id"), FOLD) == held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            z = scorer.logits(batch.column(1))
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(common.trimmed(run), SCHEMA)


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents scored under the threshold, all columns kept; no exchange."""
    common.small_batches(docs.sparkSession)
    sent = common.send(docs.sparkSession, model)
    place = docs.columns.index("text")
    limit = math.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            z = scorer.logits(batch.column(place))
            yield batch.filter(pa.array(z < limit))

    return docs.mapInArrow(common.trimmed(run), docs.schema)
