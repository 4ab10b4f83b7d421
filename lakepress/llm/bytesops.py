"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A batch of strings is one flat byte array plus document offsets, so that word
splitting and hashing run as whole-array numpy operations and no Python string
is made per word.  A word here is a maximal run of ASCII digits, ASCII letters
(lower-cased) and non-ASCII characters: the class
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Every byte of a
non-ASCII character is at least 0x80, so bytes decide the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are cut into groups of about so many bytes before numpy sees them, which bounds a worker's memory.
GROUP_BYTES = 2 << 20
_HASH_BLOCK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, bytes, offsets. A longer text is a run of its own."""
    data, offsets = flat(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def pieces(column: pa.Array, limit: int, align: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of runs of about `limit` bytes; a longer text comes in several runs, cut at multiples of `align`.

    For what can be summed up over the parts of a text, so that memory does not grow with its length.
    """
    for i, j, data, offsets in groups(column, limit):
        if j - i > 1 or len(data) <= limit:
            yield np.arange(i, j), data, offsets
            continue
        step = max(align, limit // align * align)
        for at in range(0, len(data), step):
            part = data[at : at + step]
            yield np.array([i]), part, np.array([0, len(part)])


# What a byte at a place within its span adds to the span's hash: bijective mixing of a random number of the byte plus
# the place times an odd constant. Unlike powers of a base, no two strings of the same structure cancel out.
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_NEAR = 64
_NEAR_TERMS = mix64(_BYTE_VALUE[None, :] + np.arange(_NEAR, dtype=np.uint64)[:, None] * _GOLDEN).reshape(-1)


def _long_span(data: np.ndarray) -> np.uint64:
    total = np.uint64(0)
    for at in range(0, len(data), _HASH_BLOCK):
        part = data[at : at + _HASH_BLOCK]
        total += mix64(_BYTE_VALUE[part] + np.arange(at, at + len(part), dtype=np.uint64) * _GOLDEN).sum(dtype=np.uint64)
    return total


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that hold a byte at least, never 0."""
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    upto = np.cumsum(sizes)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            before = int(upto[i] - sizes[i])
            j = max(i + 1, int(np.searchsorted(upto, before + _HASH_BLOCK, "right")))
            if j == i + 1 and sizes[i] > _HASH_BLOCK:
                out[i] = _long_span(data[starts[i] : ends[i]])
            else:
                own = sizes[i:j]
                first = upto[i:j] - own - before
                place = np.arange(int(upto[j - 1]) - before) - np.repeat(first, own)
                byte = data[place + np.repeat(starts[i:j], own)]
                if int(own.max()) <= _NEAR:
                    terms = _NEAR_TERMS[place * 256 + byte]
                else:
                    terms = mix64(_BYTE_VALUE[byte] + place.astype(np.uint64) * _GOLDEN)
                out[i:j] = np.add.reduceat(terms, first)
            i = j
        out = mix64(out + sizes.astype(np.uint64) * _GOLDEN)
    out[out == 0] = 1
    return out


def word_pieces(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """One text in parts of about `limit` bytes that end after a byte that is not part of a word, where there is one."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + limit)
        if to < n:
            gaps = np.flatnonzero(~_IS_WORD[_LOWER[data[at:to]]])
            to = at + int(gaps[-1]) + 1 if len(gaps) else to
        yield data[at:to]
        at = to


class Words:
    """The words of a run of texts.

    low: the bytes, lower-cased; starts, ends: byte spans of the words; hashes:
    of the words; first: for each text the index of its first word, and at the
    end the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.low = _LOWER[data]
        inside = _IS_WORD[self.low]
        edge = np.zeros(len(inside) + 1, bool)  # a text begins here
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_spans(self.low, self.starts, self.ends) if hashed else None

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, joined by one space."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j]))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and the text of each; a shorter text that has words is one shingle."""
    counts = np.diff(words.first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + words.first[:-1][owner]
    have = np.minimum(counts, width)[owner]
    out = np.zeros(len(at), np.uint64)
    hashes = words.hashes
    if len(hashes):
        short = bool((have < width).any())
        for k in range(width):
            out *= _GOLDEN
            if short:
                out += np.where(k < have, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0))
            else:
                out += hashes[at + k]
    return mix64(out), owner


class HashIndex:
    """An open-addressing table from nonzero 64-bit hashes to row numbers, looked up for whole arrays at once."""

    def __init__(self, bits: int = 16):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, self.rows[slot], np.int32(-1))
        rest = np.flatnonzero((found != h) & (found != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & mask
            found = self.keys[slot]
            want = h[rest]
            hit = found == want
            out[rest[hit]] = self.rows[slot[hit]]
            more = ~hit & (found != 0)
            rest, slot = rest[more], slot[more]
        return out

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Add distinct hashes that are not there yet; their rows follow those that are there."""
        while (self.size + len(h)) * 2 > len(self.keys):
            keep = self.keys != 0
            keys, rows, size = self.keys[keep], self.rows[keep], self.size
            self._reset(self.bits + 1)
            self._put(keys, rows)
            self.size = size
        rows = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self._put(h, rows)
        self.size += len(h)
        return rows

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several the last one wins
            won = self.keys[slot] == h
            self.rows[slot[won]] = rows[won]
            h, rows, slot = h[~won], rows[~won], (slot[~won] + 1) & mask
