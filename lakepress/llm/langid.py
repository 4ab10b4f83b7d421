"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of a fixed number of bytes, all of them, the last one
filled up with zeros.  Bytes have vectors; filters of several widths run over
them, the maximum over the window is taken for each filter after ReLU, and a
softmax reads the maxima.  Vectors, filters and softmax are trained together by
Adam on a bounded sample of windows.  A text's score for a language is the
softmax of the windows' mean logits, weighted by their bytes.

A filter of width w over bytes is a sum of parts that depend on one pair of
bytes each, so scoring looks up tables of all byte pairs (made once from vectors
and filters) instead of multiplying matrices.

`und` with score 0 is given where the text is null or has no letter, or where
nothing could be learned. Rows whose lang, id or text is null are not learned
from; rows that repeat id and text count once. Repeated rows are judged each for itself; a long text
is read in parts; other columns are not read; an empty table gives an empty result. With one
language only, that one is predicted with score 1.
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
from lakepress.llm.bytesops import pieces

WIDTHS = (2, 3, 4)
FILTERS = 16
DIMENSIONS = 8
WINDOW = 256
#: Bytes that are looked at at once.
PART = 1 << 20
#: Windows that training uses at most, and windows from one text.
SAMPLE_WINDOWS = 6_000
WINDOWS_PER_TEXT = 2
EPOCHS = 6
FOLD, HELD_OUT = 4, 2

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    """Languages; the filters' widths, for each its pair tables (65536 x filters) and bias; softmax weights and bias."""

    langs: list[str]
    widths: tuple[int, ...]
    tables: list[list[np.ndarray]]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """windows: n x WINDOW bytes. An odd filter's last pair has no second byte; the one more here weighs nothing."""
        wide = np.pad(windows, ((0, 0), (0, 1)))
        pairs = wide[:, :-1].astype(np.int32) * 256 + wide[:, 1:]
        maxima = []
        for width, tables, bias in zip(self.widths, self.tables, self.biases):
            n = windows.shape[1] - width + 1
            total = tables[0][pairs[:, :n]]
            for k in range(1, len(tables)):
                total += tables[k][pairs[:, 2 * k : 2 * k + n]]
            maxima.append(np.maximum(total.max(1) + bias, 0))
        return np.concatenate(maxima, 1) @ self.out + self.bias


def cut(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all bytes of all texts (n x size), the text of each, and its number of bytes."""
    lengths = np.diff(offsets)
    n = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][owner] + nth * size
    count = np.minimum(size, offsets[1:][owner] - start)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    windows = padded[start[:, None] + np.arange(size)]
    windows[np.arange(size) >= count[:, None]] = 0
    return windows, owner, count


def _pair_tables(width: int, vectors: np.ndarray, filters: np.ndarray) -> list[np.ndarray]:
    """Tables whose sums over byte pairs 2k, 2k + 1 are the filters' outputs; an odd last byte takes its pair's first."""
    parts = [vectors @ filters[k] for k in range(width)] + [np.zeros((256, filters.shape[2]), np.float32)] * (width % 2)
    return [(parts[k][:, None, :] + parts[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for k in range(0, len(parts), 2)]


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Train all weights on windows (n x WINDOW bytes) and the numbers of their languages."""
    rng = np.random.default_rng(seed)
    classes = len(langs)
    vectors = rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32)
    filters = [rng.normal(0, 1 / math.sqrt(w * DIMENSIONS), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    values = [vectors, *filters, *biases, out, bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, batch = 0, 64
    total = max(1, epochs * math.ceil(len(y) / batch))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            x = windows[pick]
            n = len(pick)
            embedded = vectors[x]
            grads = [np.zeros_like(v) for v in values]
            maxima, places = [], []
            for w, f, b in zip(WIDTHS, filters, biases):
                size = x.shape[1] - w + 1
                response = sum((embedded[:, k : k + size] @ f[k] for k in range(w)), start=np.float32(0))
                place = response.argmax(1)
                places.append(place)
                maxima.append(np.maximum(np.take_along_axis(response, place[:, None, :], 1)[:, 0] + b, 0))
            hidden = np.concatenate(maxima, 1)
            kept = (rng.random(hidden.shape) < 0.8).astype(np.float32) / np.float32(0.8)
            dropped = hidden * kept
            z = dropped @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[pick]] -= 1
            p /= n
            grads[-2][:] = dropped.T @ p
            grads[-1][:] = p.sum(0)
            to_hidden = (p @ out.T) * kept * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                g = to_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + len(WIDTHS) + k][:] = g.sum(0)
                at = places[k]
                for j in range(w):
                    byte = x[np.arange(n)[:, None], at + j]
                    grads[1 + k][j] = np.einsum("nfd,nf->df", vectors[byte], g)
                    np.add.at(grads[0], byte, g[:, :, None] * filters[k][j].T[None])
            step += 1
            rate = 0.01 * (1 - 0.9 * step / total)
            for v, g, m1, m2 in zip(values, grads, first, second):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
    return Model(langs, WIDTHS, [_pair_tables(w, vectors, f) for w, f in zip(WIDTHS, filters)], biases, out, bias)


def fit(docs: DataFrame, sample_windows: int = SAMPLE_WINDOWS, held_out: int = HELD_OUT) -> Model | None:
    """Learn from a bounded sample: as many texts of each language, and windows at places given by the hash of the id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("__lang"))
    rows = rows.where(F.col("__lang").isNotNull() & F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), FOLD) != held_out))
    found = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return None
    langs = sorted(found)
    want = max(1, sample_windows // WINDOWS_PER_TEXT // len(langs))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, want / n))]), F.col("__lang"))
    rows = rows.withColumn("__h", F.xxhash64("text"))
    chosen = rows.where(samples.unit("doc_id", "__h", seed=5) < rate).where(F.rlike("text", F.lit("\\p{L}")))
    places = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS_PER_TEXT)), lambda k: F.pmod(F.xxhash64("doc_id", k), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1)
    windows = chosen.select("doc_id", "__h", "__lang", F.explode(places).alias("__at"), "text").select("doc_id", "__h", "__lang", "__at", F.substring("text", F.col("__at"), F.lit(WINDOW)).alias("text"))
    sample = windows.dropDuplicates(["doc_id", "__h", "__at"]).limit(2 * sample_windows + 1000)

    def learn(rows: pa.Table) -> Model:
        raw = [t.encode()[:WINDOW] for t in rows["text"].to_pylist()]
        x = np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in raw), np.uint8).reshape(-1, WINDOW)
        number = {k: i for i, k in enumerate(langs)}
        return train(x, np.array([number[k] for k in rows["__lang"].to_pylist()]), langs)

    return samples.trained(sample, ["doc_id", "__h", "__at"], learn)


def predict(docs: DataFrame, model: Model | None, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; no exchange."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = common.send(spark, model)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        (common.fold(F.col("doc_id").cast("long"), FOLD) == held_out).alias("held_out"),
        F.coalesce(F.rlike("text", F.lit("\\p{L}")), F.lit(False)).alias("letters"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            n, letters = batch.num_rows, batch.column(3).to_numpy(zero_copy_only=False)
            if net is None:
                names, score = ["und"] * n, np.zeros(n)
            else:
                total, size = np.zeros((n, len(net.langs))), np.zeros(n)
                for of, data, offsets in pieces(batch.column(1), PART, WINDOW):
                    windows, owner, count = cut(data, offsets)
                    logits = np.concatenate([np.zeros((0, len(net.langs)), np.float32)] + [net.logits(windows[k : k + 128]) for k in range(0, len(windows), 128)])
                    total[of] += np.stack([np.bincount(owner, weights=logits[:, c] * count, minlength=len(of)) for c in range(len(net.langs))], 1)
                    size[of] += np.diff(offsets)
                mean = total / np.maximum(size, 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                names = [net.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
                score = np.where(letters, np.round(p[np.arange(n), best], 6), 0.0)  # equal texts in other batches differ in the last bits
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(common.trimmed(run), SCHEMA)
