"""Best-fit packing: bounded-space online best fit over a bitset of free space.

Texts become token ids and an end id; only documents longer than a sequence are
cut, into whole sequences after a shorter first piece.  A task packs the pieces
it gets one by one into a fixed number of open sequences.  A bitset holds for
each amount of free space whether an open sequence has just that much, so the
best fit (the fullest sequence with room) is the lowest set bit from the piece's
length on; without one a new sequence opens, and where too many are open the
fullest closes first.  Pieces are placed online, each for good; they pass through a
buffer of `window` pieces, which hands on the longest first, so that long ones
open sequences that short ones fill (`window=1` is the order of arrival).

Only lengths and digests are exchanged (or also the ids, with `with_ids`), dealt
by the hash of id, piece and input partition in a fixed order, so a task that runs
again packs alike, and rows that repeat an id are dealt apart.
Memory for packing is bounded by the open sequences and a window, whatever the
input. sequence_id is the task's number times 2**40 plus a count.

A null or empty text is the end id alone. Null ids are allowed; rows that repeat
an id are documents of their own. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm import common, tokens

LENGTH = 1024
OPEN_BINS = 4096
WINDOW = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Open bins of one capacity, keyed by free space; place() returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f is set if an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        room = self.free >> length
        if room:
            f = length + (room & -room).bit_length() - 1
            which = self.bins[f].pop()
            if not self.bins[f]:
                self.free ^= 1 << f
        else:
            if self.count >= self.limit:
                self._close_fullest()
            f, which = self.capacity, self.opened
            self.opened += 1
            self.count += 1
        left = f - length
        if left:
            self.bins[left].append(which)
            self.free |= 1 << left
        else:
            self.count -= 1
        return which, self.capacity - f

    def _close_fullest(self) -> None:
        f = (self.free & -self.free).bit_length() - 1
        self.bins[f].pop()
        if not self.bins[f]:
            self.free ^= 1 << f
        self.count -= 1


def place_all(lengths: np.ndarray, capacity: int, open_bins: int, window: int, packer: BestFit | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of pieces, window by window."""
    packer = packer or BestFit(capacity, open_bins)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for at in range(0, len(lengths), window):
        part = lengths[at : at + window]
        for k in np.argsort(-part, kind="stable").tolist():
            bins[at + k], offsets[at + k] = packer.place(int(part[k]))
    return bins, offsets


def cut(n: int, length: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    return ([n % length] if n % length else []) + [length] * (n // length)


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, with_ids: bool = False, specials: bool = False) -> DataFrame:
    """One row for each piece of each document; no exchange."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, bounds in tokens.encode_column(batch.column(1), tokenizer, end_id, specials):
                row, nth, start, size, crc, body = [], [], [], [], [], []
                for k in range(j - i):
                    own = ids[bounds[k] : bounds[k + 1]]
                    at = 0
                    for p, n in enumerate(cut(len(own), length)):
                        part = own[at : at + n].astype("<u4").tobytes()
                        row.append(i + k)
                        nth.append(p)
                        start.append(at)
                        size.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            body.append(part)
                        at += n
                out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(body, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return common.texts(docs).mapInArrow(common.trimmed(run), PIECES + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = 2, open_bins: int = OPEN_BINS, window: int = WINDOW, with_ids: bool = False, specials: bool = False
) -> DataFrame:
    """Pieces with their sequence_id and offset; with `with_ids` also the ids of each piece as little-endian 32-bit integers."""
    cut_up = pieces(docs, tokenizer or tokens.default_path(), length, end_id, with_ids, specials)
    dealt = cut_up.withColumn("__from", F.spark_partition_id()).repartition(F.xxhash64("doc_id", "piece", "ids_crc32", "__from")).drop("__from").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        packer = BestFit(length, open_bins)
        held: list[pa.RecordBatch] = []
        waiting = 0

        def placed() -> Iterator[pa.RecordBatch]:
            for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
                bins, offsets = place_all(batch.column(3).to_numpy(), length, open_bins, window, packer)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins + first), pa.array(offsets)], [*batch.schema.names, "sequence_id", "offset"])
            held.clear()

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= window:
                yield from placed()
                waiting = 0
        if held:
            yield from placed()

    return dealt.mapInArrow(common.trimmed(run), PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")
