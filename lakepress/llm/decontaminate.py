"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: runs of `window` words,
or all words of an item that has fewer.  For patterns of m words a table from
hashed blocks of two words to shifts says how far a search position may move
without missing an occurrence (up to m - 1 words); where the shift is 0 the
hash of the last block selects a bucket of patterns, in which the hash of all
words finds the one that may occur here, and its words are
compared directly with the text.  Many positions move at once: every text is
cut into overlapping segments, and each step advances all of them. The tables have
8 places for each block of two words, up to 2**24, so shifts stay long.

Benchmark items are the stated query set. They are read to the driver in
blocks of about `block_bytes` (a longer item comes in several, which overlap), and the machine
of each block, a few flat arrays, is broadcast after a check of its size. Up to HELD_BYTES of them a worker keeps
all; beyond, it gathers batches of HELD_BYTES of texts, loads one machine after the other and drops
it again, so a worker's memory is bounded for any benchmark and any corpus.

Null or empty texts have no words and no hits; items without words have no
windows. Repeated rows are judged each for itself; repeated items count once
by their id. A null item id is written as an empty string. search() reads no other columns, clean()
keeps them as they are. An empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.llm import common
from lakepress.llm.bytesops import Words, groups, mix64

WINDOW = 10
BLOCK_BYTES = 2 << 20
HELD_BYTES = 64 << 20
_LEAST_BITS, _MOST_BITS = 12, 24
_SEGMENT = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _of_all(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words from each of the given ones on."""
    out = np.full(len(first), length, np.uint64)
    for k in range(length):
        out = mix64(out * _MIX + hashes[first + k])
    return out


class WuManber:
    """Search for patterns of one length: runs of words of the block's texts, as the place of their first word, with the items that have them."""

    def __init__(self, length: int, words: Words, numbers: np.ndarray, first: np.ndarray, items: np.ndarray):
        """numbers: of the words, equal for equal ones; first, items: the patterns' first words and their items."""
        self.length, self.block = length, min(2, length)
        rows = np.concatenate([numbers[first[:, None] + np.arange(length)], items[:, None]], 1)
        _, where = np.unique(rows, axis=0, return_index=True)  # each pattern of an item once
        rows, first = rows[where], first[where]
        new = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(1)])
        at = np.flatnonzero(new)
        self.first, ends = first[at].astype(np.int32), np.append(at, len(rows))
        blocks = first[at][:, None] + np.arange(self.block - 1, length)
        self.bits = _LEAST_BITS
        pairs = len(np.unique(self._blocks(words.hashes, blocks.reshape(-1))))
        self.bits = int(min(_MOST_BITS, max(_LEAST_BITS, (8 * pairs - 1).bit_length())))
        self.shift = np.full(1 << self.bits, min(length - self.block + 1, 255), np.uint8)
        for k in range(length - self.block + 1):
            np.minimum.at(self.shift, self.slots(words.hashes, blocks[:, k]), np.uint8(min(length - self.block - k, 255)))
        key = self._keys(words.hashes, self.first.astype(np.int64))
        order = np.argsort(key, kind="stable")
        self.keys, self.first = key[order], self.first[order]
        counts = np.diff(ends)[order]
        self.item_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.items = rows[np.arange(int(counts.sum())) + np.repeat(ends[:-1][order] - self.item_at[:-1], counts), -1].astype(np.int32)

    def _blocks(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64(hashes[ends - 1] * _MIX + hashes[ends]) if self.block == 2 else hashes[ends]

    def slots(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table slots of the blocks that end at the given words."""
        return (self._blocks(hashes, ends) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _keys(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The bucket (slot of the last block), and in it the hash of all words."""
        slot = self.slots(hashes, first + self.length - 1).astype(np.uint64)
        return (slot << np.uint64(64 - self.bits)) | (_of_all(hashes, first, self.length) >> np.uint64(self.bits))

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words at which a pattern may end, in no order; first: where each text's words begin, and the end."""
        m = self.length
        counts = np.diff(first)
        long = np.flatnonzero(counts >= m)
        if not len(long):
            return np.zeros(0, np.int64)
        starts = counts[long] - m + 1
        pieces = -(-starts // _SEGMENT)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text = np.repeat(long, pieces)
        at = first[text] + nth * _SEGMENT + m - 1
        limit = np.minimum(at + _SEGMENT, first[text + 1])
        found = []
        while len(at):
            step = self.shift[self.slots(hashes, at)].astype(np.int64)
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                step[hit] = 1
            at = at + step
            more = at < limit
            at, limit = at[more], limit[more]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, words: Words, texts: Words) -> Iterator[tuple[int, list[int]]]:
        """The first word of each occurrence in `words` and the items that have it; texts: of the benchmark's block."""
        first = self.candidates(words.hashes, words.first) - self.length + 1
        if not len(first):
            return
        keys = self._keys(words.hashes, first)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        for k in np.flatnonzero(low < high).tolist():
            at = int(first[k])
            own = words.text(at, at + self.length)
            for p in range(int(low[k]), int(high[k])):
                start = int(self.first[p])
                if texts.text(start, start + self.length) == own:
                    yield at, self.items[self.item_at[p] : self.item_at[p + 1]].tolist()


class Block:
    """Some items' texts, their names, and a machine for each length of windows."""

    def __init__(self, items: list[tuple[str, bytes, int]], window: int):
        """items: name, text, and the length of its windows."""
        self.names = [name for name, _, _ in items]
        offsets = np.cumsum([0, *(len(t) for _, t, _ in items)])
        self.words = Words(np.frombuffer(b"".join(t for _, t, _ in items), np.uint8), offsets)
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(self.words.low[s:e].tobytes(), len(known)) for s, e in zip(self.words.starts.tolist(), self.words.ends.tolist())], np.int64)
        counts, length = np.diff(self.words.first), np.array([m for _, _, m in items], np.int64)
        self.machines = []
        for m in sorted(set(length.tolist())):
            own = np.flatnonzero(length == m)
            n = counts[own] - m + 1
            of = np.repeat(own, n)
            first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.words.first[of]
            self.machines.append(WuManber(int(m), self.words, numbers, first, of))
        self.words.hashes = self.words.first = None
        self.words.starts, self.words.ends = self.words.starts.astype(np.int32), self.words.ends.astype(np.int32)

    def search(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, number of words, and names of each occurrence."""
        for machine in self.machines:
            for at, found in machine.occurrences(words, self.words):
                yield at, machine.length, [self.names[k] for k in found]


def blocks(items: Iterator[tuple[str, str]], window: int, block_bytes: int) -> Iterator[Block]:
    """Machines for all items, each over about `block_bytes` of texts."""
    held: list[tuple[str, bytes, int]] = []
    size = 0
    for name, text in items:
        for _, _, data, offsets in groups(pa.array([text], pa.large_string())):
            words = Words(data, offsets, hashed=False)
            n = len(words.starts)
            at = 0
            while n and (at == 0 or at + window <= n):
                to = max(at + 1, int(np.searchsorted(words.ends, (words.starts[at] if at < n else 0) + block_bytes, "right")))
                part = words.text(at, min(n, to + window - 1))
                held.append((name, part, min(n, window)))
                size += len(part) + 100
                if size >= block_bytes:
                    yield Block(held, window)
                    held, size = [], 0
                at = to
    if held:
        yield Block(held, window)


class Sent:
    """Machines as broadcasts, and how a worker goes through them."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, window: int, block_bytes: int, held_bytes: int = HELD_BYTES):
        rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
        self.parts: list[Broadcast] = []
        size = 0
        for block in blocks(((r[0], r[1]) for r in rows.toLocalIterator()), window, block_bytes):
            size += len(pickle.dumps(block, protocol=5))
            self.parts.append(common.send(spark, block))
        self.held_bytes = held_bytes
        self.all_held = size <= held_bytes

    def gathered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if self.all_held or size >= self.held_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def loaded(self) -> Iterator[Block]:
        for part in self.parts:
            yield part.value
            if not self.all_held:
                vars(part).pop("_value", None)  # the worker's copy; it is read again from the executor's file


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, spans: bool = False, held_bytes: int = HELD_BYTES) -> DataFrame:
    """For each document: words, hit words, items, the digest of their ids, and whether any word is hit.

    With `spans` also items array<string> and spans array<struct<first, end>> of hit words.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = Sent(spark, benchmark, window, block_bytes, held_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sent.gathered(batches):
            counts: list[list[int]] = [[] for _ in held]
            found: list[dict[int, tuple[list[tuple[int, int]], set[str]]]] = [{} for _ in held]  # rows with hits
            for nth, block in enumerate(sent.loaded()):
                for b, batch in enumerate(held):
                    for i, _, data, offsets in groups(batch.column(1)):
                        words = Words(data, offsets)
                        if nth == 0:
                            counts[b] += np.diff(words.first).tolist()
                        for at, n, names in block.search(words):
                            k = int(np.searchsorted(words.first, at, "right")) - 1
                            runs, items = found[b].setdefault(i + k, ([], set()))
                            runs.append((at - int(words.first[k]), n))
                            items.update(names)
            if not sent.parts:
                counts = [[n for _, _, data, offsets in groups(batch.column(1)) for n in np.diff(Words(data, offsets, hashed=False).first).tolist()] for batch in held]
            for b, batch in enumerate(held):
                hit, names, merged = [0] * batch.num_rows, [()] * batch.num_rows, [[]] * batch.num_rows
                for k, (runs, items) in found[b].items():
                    names[k], merged[k] = sorted(items), []
                    for at, n in sorted(runs):
                        if merged[k] and at <= merged[k][-1]["end"]:
                            merged[k][-1]["end"] = max(merged[k][-1]["end"], at + n)
                        else:
                            merged[k].append({"first": at, "end": at + n})
                    hit[k] = sum(x["end"] - x["first"] for x in merged[k])
                out = [
                    batch.column(0),
                    pa.array(counts[b], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array([n > 0 for n in hit]),
                ]
                names_out = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                if spans:
                    out += [pa.array([list(x) for x in names], pa.list_(pa.string())), pa.array(merged, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                    names_out += ["items", "spans"]
                yield pa.RecordBatch.from_arrays(out, names_out)

    schema = SCHEMA + (", items array<string>, spans array<struct<first: long, end: long>>" if spans else "")
    return common.texts(docs).mapInArrow(common.trimmed(run), schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The documents without any hit word, all columns kept; no row is exchanged."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = Sent(spark, benchmark, window, block_bytes, held_bytes)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sent.gathered(batches):
            keep = [np.ones(batch.num_rows, bool) for batch in held]
            for block in sent.loaded():
                for b, batch in enumerate(held):
                    for i, _, data, offsets in groups(batch.column(place)):
                        words = Words(data, offsets)
                        for at, _, _ in block.search(words):
                            keep[b][i + int(np.searchsorted(words.first, at, "right")) - 1] = False
            for batch, stay in zip(held, keep):
                yield batch.filter(pa.array(stay))

    return docs.mapInArrow(common.trimmed(run), docs.schema)


#: The same rows for DuckDB, by plain joins of word windows.
SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM dw, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
found AS (SELECT doc_id, grams.m, i, item_id FROM grams JOIN pat ON grams.m = pat.m AND grams.g = pat.g),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
