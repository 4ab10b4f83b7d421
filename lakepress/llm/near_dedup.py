"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its runs of five words: count times inverse document
frequency.

1. Document frequencies come from all documents, in two passes. A shingle that a share
   FLOOR_SHARE of them has is found in the tasks: each counts its own texts' shingles (a table of
   bounded size, lossy counting) and names those that a quarter of that share of its texts have;
   one that passes the share over all must be named by tasks that hold three quarters of it, so at most
   4/3 / FLOOR_SHARE times the mean number of shingles of a text are left. Their documents are then counted
   exactly by the shingle's hash. Texts that share their first sample (below, unweighted) count once, as
   copies, exact or near, mostly do: else a large group of copies would take the weight from its
   own text. The weight is ln(1 + 1 / share) over ln(1 + 1 / FLOOR_SHARE), smooth, and 1 for
   all rarer shingles: how rare one is beyond that says nothing about copies.
2. Improved consistent weighted sampling draws BANDS x ROWS samples from each
   set: for a shingle of weight w, t = floor(ln w / r + b) and
   ln a = ln c - r (t - b + 1) with r, c ~ Gamma(2, 1) and b uniform, all fixed by the
   shingle's hash and the sample's number; the shingle of least a is the sample, with its t. Two
   texts share a sample with the probability of their weighted Jaccard similarity.
3. Texts that share all samples of a band are linked to the smallest of them.
   The components of these links hold every pair worth comparing.
4. The sets of texts in components are brought together, cell by cell, and each
   pair's weighted Jaccard similarity is computed; links of at least `threshold`
   make the classes. A cell holds at most CELL_TEXTS texts and CELL_SHINGLES
   shingles. A component beyond that is divided into cells by its bands, and a
   band beyond it by hash into parts, where every two parts are a cell: all texts that
   share a band are compared, at a cost that grows with the square of such a band's texts.
   The links of all its cells are then joined again.

Equal texts are one node (by their SHA-256), so copies cost one row
each. Null counts as the empty text; texts without words are alone, but for
equal ones. A text of fewer than five words is one shingle. Rows that repeat an id
are rows of their own, and keep or lose their place by their own text. An empty table gives an
empty result. Of a class the row with the smallest doc_id stays (nulls last; of texts that share
it the one with the smallest digest). classes() reads no other columns; distinct() keeps them
as they are, whatever their names. Tables that are written on the way are removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.llm import common
from lakepress.llm.bytesops import Words, groups, mix64, shingles
from lakepress.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
#: The least share of documents that counts; shingles that a task counts at a time.
FLOOR_SHARE = 1 / 64
COUNTED = 1 << 19
CELL_TEXTS, CELL_SHINGLES = 2_000, 4_000_000

_DRAWS_BITS = 16
_rng = np.random.Generator(np.random.PCG64(97))
_R = _rng.gamma(2.0, 1.0, 1 << _DRAWS_BITS).astype(np.float32)
_LNC = np.log(_rng.gamma(2.0, 1.0, 1 << _DRAWS_BITS)).astype(np.float32)
_B = _rng.random(1 << _DRAWS_BITS).astype(np.float32)
_KEYS = _rng.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ID_BITS = 44
#: Names that are no shingle: the number of texts with words, and of their shingles.
_ROWS, _SHINGLES = np.uint64((1 << 64) - 1), np.uint64((1 << 64) - 2)


class Frequencies:
    """Weights of frequent shingles: their hashes, ascending, and what each weighs; all others weigh 1."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, floor_share: float = FLOOR_SHARE):
        order = np.argsort(ids)
        self.ids = np.asarray(ids, np.uint64)[order]
        share = np.clip(np.asarray(shares, np.float64)[order], floor_share, 1.0)
        self.weights = (np.log1p(1 / share) / math.log1p(1 / floor_share)).astype(np.float32)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), np.float32)
        if len(self.ids) and len(ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            out[hit] = self.weights[at[hit]]
        return out


def weighted_sets(data: np.ndarray, offsets: np.ndarray, idf: Frequencies | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle ids (ascending within a text), weights, and where each text's begin; without `idf` the weights are counts."""
    hashes, owner = shingles(Words(data, offsets), WIDTH)
    n = len(offsets) - 1
    key = (owner.astype(np.uint64) << np.uint64(_ID_BITS)) | (hashes >> np.uint64(64 - _ID_BITS))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(key)))
    key = key[at]
    first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(_ID_BITS))
    ids = key & np.uint64((1 << _ID_BITS) - 1)
    weights = counts.astype(np.float32)
    return ids, weights if idf is None else weights * idf(ids), first


class Counter:
    """Counts of numbers in a table of bounded size: where it overflows, the least counts go, and `error` is what one may lack."""

    def __init__(self, limit: int = COUNTED):
        self.limit, self.error, self.waiting = limit, 0, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.waiting += len(keys)
        if self.waiting >= self.limit:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        fresh, counts = np.unique(np.concatenate(self.new), return_counts=True)
        self.new, self.waiting = [], 0
        keys, of = np.unique(np.concatenate([self.keys, fresh]), return_inverse=True)
        counts = np.bincount(of, weights=np.concatenate([self.counts, counts]), minlength=len(keys)).astype(np.int64)
        if len(keys) > self.limit:
            least = int(np.partition(counts, len(counts) - self.limit // 2)[len(counts) - self.limit // 2])
            stay = counts > least
            keys, counts, self.error = keys[stay], counts[stay], self.error + least
        self.keys, self.counts = keys, counts


def samples(ids: np.ndarray, weights: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """`count` consistent weighted samples (as 64-bit hashes of shingle and t) of each nonempty set."""
    n = len(first) - 1
    out = np.zeros((n, count), np.uint64)
    filled = np.flatnonzero(np.diff(first) > 0)
    if not len(filled):
        return out
    starts, sizes = first[:-1][filled], np.diff(first)[filled]
    lw = np.log(weights)
    usual = lw.max() if not len(lw) else np.median(lw)
    t0 = np.floor(usual / _R + _B)
    a0 = _LNC - _R * (t0 - _B + 1)
    odd = np.flatnonzero(lw != usual)
    mixed = mix64(ids + np.uint64(1))
    for d in range(count):
        slot = ((mixed * _KEYS[d]) >> np.uint64(64 - _DRAWS_BITS)).astype(np.int64)
        a = a0[slot]
        if len(odd):
            own = slot[odd]
            t_odd = np.floor(lw[odd] / _R[own] + _B[own])
            a[odd] = _LNC[own] - _R[own] * (t_odd - _B[own] + 1)
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, sizes))
        at = at[np.searchsorted(at, starts)]  # of equal ones the smallest id
        t = np.floor(lw[at] / _R[slot[at]] + _B[slot[at]])
        out[filled, d] = mix64(ids[at] * np.uint64(0x9E3779B97F4A7C15) + t.astype(np.int64).astype(np.uint64))
    return out


def bands(drawn: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of `rows` samples."""
    out = np.zeros((len(drawn), drawn.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        h = np.full(len(drawn), b + 1, np.uint64)
        for k in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + drawn[:, b * rows + k])
        out[:, b] = h
    return out


def similarities(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a bounded number of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    ids = np.concatenate([s for s, _ in sets])
    w = np.concatenate([x for _, x in sets]).astype(np.float64)
    total = np.bincount(owner, weights=w, minlength=n)
    order = np.lexsort((owner, ids))
    ids, owner, w = ids[order], owner[order], w[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(at, len(ids)))
    shared = np.zeros((n, n))
    if len(at):
        even = (np.minimum.reduceat(w, at) == np.maximum.reduceat(w, at)) & (sizes > 1)
        columns = np.flatnonzero(even)
        for k in range(0, len(columns), 2048):  # shingles that weigh the same in all their texts
            part = columns[k : k + 2048]
            rows = np.concatenate([np.arange(at[c], at[c] + sizes[c]) for c in part])
            dense = np.zeros((n, len(part)), np.float32)
            dense[owner[rows], np.repeat(np.arange(len(part)), sizes[part])] = np.sqrt(w[rows])
            shared += dense @ dense.T
        for c in np.flatnonzero(~even & (sizes > 1)).tolist():
            own, x = owner[at[c] : at[c] + sizes[c]], w[at[c] : at[c] + sizes[c]]
            shared[np.ix_(own, own)] += np.minimum.outer(x, x)
    union = total[:, None] + total[None, :] - shared
    return np.where(union > 0, shared / np.maximum(union, 1e-12), 0.0)


def linked(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """The first member of each set's class."""
    close = similarities(sets) >= threshold - 1e-6
    label = np.arange(len(sets))
    while True:
        new = np.where(close, label[None, :], len(sets)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _text_id(text: str | Column = "text") -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _sets(column: pa.Array, idf: Frequencies | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, and their weighted sets."""
    for i, j, data, offsets in groups(column):
        yield i, j, *weighted_sets(data, offsets, idf)


def frequent(docs: DataFrame, floor_share: float = FLOOR_SHARE, counted: int = COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least this share of all documents have (copies mostly once), and the share of each; both passes read all rows."""
    spark = docs.sparkSession
    common.small_batches(spark)
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, rows, total = Counter(counted), 0, 0
        for batch in batches:
            for _, _, ids, _, first in _sets(batch.column(0), None):
                counter.add(ids)
                total += len(ids)
                rows += int((np.diff(first) > 0).sum())
        counter.settle()
        hit = counter.counts + counter.error >= floor_share / 4 * rows
        keys = np.append(counter.keys[hit], np.array([_ROWS, _SHINGLES]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.append(counter.counts[hit] + counter.error, [rows, total]))], ["k", "n"])

    totals = own.mapInArrow(common.trimmed(named), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    with common.Scratch() as scratch:
        totals = scratch.written(totals, "named")
        known = {r["k"]: r["n"] for r in totals.where(F.col("k").isin(_ROWS.astype(np.int64).item(), _SHINGLES.astype(np.int64).item())).collect()}
        rows = known.get(_ROWS.astype(np.int64).item(), 0)
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(0)
        found = totals.where((F.col("k") >= 0) & (F.col("n") >= 0.75 * floor_share * rows)).select("k").toArrow()  # at most 4/3 / floor_share times the shingles of a mean text
        sent = common.send(spark, np.sort(found["k"].to_numpy().view(np.uint64)))

    def counted_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, ids, weights, first in _sets(batch.column(0), None):
                filled = np.diff(first) > 0
                key = samples(ids, np.ones(len(ids), np.float32), first, 1)[:, 0]
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                at = np.minimum(np.searchsorted(sent.value, ids), max(0, len(sent.value) - 1))
                hit = sent.value[at] == ids if len(sent.value) else np.zeros(len(ids), bool)
                pairs = np.unique(np.stack([np.append(ids[hit], np.full(int(filled.sum()), _ROWS)), np.append(key[owner[hit]], key[filled])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["k", "s"])

    told = own.mapInArrow(common.trimmed(counted_once), "k long, s long").distinct().groupBy("k").agg(F.count("*").alias("n")).toArrow()  # a row for each shingle that was sent
    keys, n = told["k"].to_numpy().view(np.uint64), told["n"].to_numpy()
    every = int(n[keys == _ROWS][0])
    hit = (keys != _ROWS) & (n >= floor_share * every)
    return keys[hit], n[hit] / every


def frequencies(docs: DataFrame, floor_share: float = FLOOR_SHARE) -> Frequencies:
    return Frequencies(*frequent(docs, floor_share), floor_share)


def _signatures(docs: DataFrame, idf: Frequencies) -> DataFrame:
    """doc_id, tid, shingles, keys (a hash for each band; none for a text without words)."""
    sent = common.send(docs.sparkSession, idf)
    rows = common.texts(docs).select("doc_id", _text_id().alias("tid"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, weights, first in _sets(batch.column(2), sent.value):
                keys = bands(samples(ids, weights, first, BANDS * ROWS)).view(np.int64)
                sizes = np.diff(first)
                filled = np.where(sizes > 0, BANDS, 0)
                flat = keys[sizes > 0].reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sizes, pa.int64()), lists], ["doc_id", "tid", "shingles", "keys"])

    return rows.mapInArrow(common.trimmed(run), "doc_id long, tid binary, shingles long, keys array<long>")


def _parted(sized: DataFrame, cell_texts: int, cell_shingles: int) -> DataFrame:
    """Cells over the limits, and into how many parts each goes, so that two of them are a cell within the limits."""
    parts = F.ceil(F.greatest(F.col("n") / (cell_texts / 2), F.col("m") / (cell_shingles / 2)))
    return sized.select("cell", F.greatest(F.lit(2), F.least(parts, F.col("n"))).cast("long").alias("parts"))


def _pairs_of_parts(rows: DataFrame) -> DataFrame:
    """(cell, tid, label) for every two parts (by hash) of each cell: any two texts of a cell meet."""
    own = rows.withColumn("p", F.pmod(F.xxhash64("tid"), F.col("parts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: q != F.col("p"))
    return own.select("cell", "tid", "label", "p", F.explode(others).alias("q")).select(F.xxhash64("cell", F.least("p", "q"), F.greatest("p", "q")).alias("cell"), "tid", "label")


def _cells(members: DataFrame, cell_texts: int, cell_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(cell, tid, label) rows of bounded cells; the label is the component's. Second: labels of divided components."""
    large = (F.col("n") > cell_texts) | (F.col("m") > cell_shingles)
    measure = [F.count("*").alias("n"), F.sum("shingles").alias("m")]
    sizes = members.groupBy("label").agg(*measure)
    over = sizes.where(large).select("label")
    whole = members.join(over, "label", "left_anti").select(F.xxhash64("label").alias("cell"), "tid", "label")
    divided = members.join(over, "label")
    one = divided.select("tid", "label", "shingles", F.explode("keys").alias("key")).withColumn("cell", F.xxhash64("label", "key"))
    over1 = _parted(one.groupBy("cell").agg(*measure).where(large), cell_texts, cell_shingles)
    first = one.join(over1, "cell", "left_anti").select("cell", "tid", "label")
    second = _pairs_of_parts(one.join(over1, "cell"))
    cells = whole.unionByName(first).unionByName(second)
    return cells, over


def _members(docs: DataFrame, scratch: common.Scratch, threshold: float, floor_share: float, cell_texts: int, cell_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tid: the text's) and, for each text of a class with others, its class (the same for all of one)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    idf = frequencies(docs, floor_share)
    sent = common.send(spark, idf)
    signed = scratch.written(_signatures(docs, idf), "signatures")

    nodes = signed.where(F.size("keys") > 0).select("tid", "shingles", "keys").dropDuplicates(["tid"])
    exploded = nodes.select("tid", F.explode("keys").alias("key"))
    met = exploded.groupBy("key").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).where("low != high").select("key", "low")
    links = exploded.join(met, "key").where("tid != low").select("tid", "low").distinct()
    found = components(links)
    scratch.tables += found._lakepress_tables
    members = scratch.written(nodes.join(found, nodes.tid == found.node).select("tid", "shingles", "keys", "label"), "members")

    cells, over = _cells(members, cell_texts, cell_shingles)
    rows = common.with_maybe(common.texts(docs).select(_text_id().alias("tid"), "text"), F.col("tid"), members.select("tid"), "maybe").where("maybe").select("tid", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, weights, first in _sets(batch.column(1), sent.value):
                body = [ids[a:b].astype("<u8").tobytes() + weights[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(body, pa.binary())], ["tid", "body"])

    sets = rows.mapInArrow(common.trimmed(describe), "tid binary, body binary").dropDuplicates(["tid"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tids, held, labels = None, [], [], []

        def done() -> pa.RecordBatch:
            firsts = linked(held, threshold) if len(held) > 1 else np.zeros(1, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array([tids[k] for k in firsts.tolist()], pa.binary()), pa.array(labels, pa.binary())], ["tid", "first", "label"])

        for batch in batches:
            for cell, tid, body, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if cell != now and tids:
                    yield done()
                    tids, held, labels = [], [], []
                now = cell
                raw = body.as_py()
                n = len(raw) // 12
                tids.append(tid)
                labels.append(of)
                held.append((np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<f4", n, 8 * n)))
        if tids:
            yield done()

    together = cells.join(sets, "tid").select("cell", "tid", "body", "label").repartition("cell").sortWithinPartitions("cell", "tid")
    compared = scratch.written(together.mapInArrow(common.trimmed(compare), "tid binary, first binary, label binary"), "compared")
    divided = scratch.written(over, "divided")
    plain = compared.join(divided, "label", "left_anti").select("tid", F.col("first").alias("class"))
    if divided.limit(1).count():
        again = components(compared.join(divided, "label", "left_semi").where("tid != first").select("tid", "first"))
        scratch.tables += again._lakepress_tables
        plain = plain.unionByName(again.select(F.col("node").alias("tid"), F.col("label").alias("class")))
    return signed.select("doc_id", "tid"), plain


def _first(rows: DataFrame, plain: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, int]:
    """For each text: n (rows), first (of its class: no_id, doc_id, tid of the row that stays), size (rows of its class); and the number of rows.

    Rows are reduced to one for each text before texts meet by class.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")
    texts = rows.groupBy("tid").agg(F.min(row).alias("own"), F.count("*").alias("n"))
    texts = scratch.written(texts.join(plain, "tid", "left").withColumn("class", F.coalesce("class", "tid")), "texts")
    total = texts.agg(F.sum("n")).first()[0] or 0
    heads = texts.groupBy("class").agg(F.min("own").alias("first"), F.sum("n").alias("size"))
    return scratch.written(common.answered(texts, heads, ["class"], "size", total).select("tid", "n", "first", "size"), "answers"), total


def classes(docs: DataFrame, threshold: float = THRESHOLD, floor_share: float = FLOOR_SHARE, cell_texts: int = CELL_TEXTS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size, kept for each row.

    The result is a table, which common.dropped() removes.
    """
    with common.Scratch() as scratch:
        rows, plain = _members(docs, scratch, threshold, floor_share, cell_texts, cell_shingles)
        answers, total = _first(rows, plain, scratch)
        joined = common.answered(rows, answers, ["tid"], "n", total)
        kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        return common.written(joined.select("doc_id", F.col("first.doc_id").alias("class_id"), F.col("size").alias("class_size"), kept.alias("kept")), "classes")


def distinct(docs: DataFrame, threshold: float = THRESHOLD, floor_share: float = FLOOR_SHARE) -> DataFrame:
    """The documents that stay, one of each class, with their columns: the smallest id (nulls last), of its texts the smallest digest.

    Rows are told apart by id and text; those that repeat both are one. The result reads a table of those that
    go, which common.dropped() removes.
    """
    maybe, own, tid = common.free(docs.columns, "__maybe", "__own", "__tid")
    with common.Scratch() as scratch:
        rows, plain = _members(docs, scratch, threshold, floor_share, CELL_TEXTS, CELL_SHINGLES)
        answers, total = _first(rows, plain, scratch)
        joined = common.answered(rows, answers.where("size > 1"), ["tid"], "n", total).where("size > 1")
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tid") == F.col("first.tid"))
        name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        marks = joined.groupBy(name.alias(own), F.col("tid").alias(tid)).agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
        gone = common.written(marks.where("not stays or rows > 1"), "gone")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    marked = common.with_maybe(docs.withColumn(own, key), F.col(own), gone.select(own), maybe)
    sure = marked.where(~F.col(maybe)).select(*docs.columns)
    told = marked.where(maybe).withColumn(tid, _text_id(F.coalesce("text", F.lit(""))))
    left = told.join(gone.select(own, tid), [own, tid], "left_anti").select(*docs.columns)
    again = told.join(gone.where("stays").select(own, tid), [own, tid], "left_semi").dropDuplicates([own, tid]).select(*docs.columns)
    return common.owning(sure.unionByName(left).unionByName(again), gone)
