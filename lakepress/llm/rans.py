"""Static range asymmetric numeral system over token ids, in independent interleaved blocks.

One table of frequencies, of 2**PRECISION in sum, serves all blocks.  A block is
coded by LANES states of 64 bits side by side: id i belongs to lane i modulo
LANES, and all lanes take a step at once.  States stay in [2**31, 2**63) and
spill 32-bit words into one stream; the coder runs from the last id to the first
and the stream is reversed, so the decoder reads both forward.  After every
CHECKPOINT_STEPS steps a checkpoint keeps all states and the place in the
stream, so the parts of a block decode side by side: here as more lanes of the
same array operations.

A block (little-endian): magic "LPR1", version, lanes, steps, ids, checkpoints,
words, crc32 of the ids as unsigned 32-bit integers, crc32 of the header (with 0 in this
place) and all that follows; then for each checkpoint its place and states, then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PRECISION = 20
LANES = 1024
CHECKPOINT_STEPS = 256
_LOW = np.uint64(1 << 31)
_HEADER = struct.Struct("<4sIIIQIQII")
_MAGIC = b"LPR1"


class Table:
    """Shared frequencies: symbols that occur, their scaled counts, first slots, and the symbol of each slot."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols = np.asarray(symbols, np.uint32)
        self.freq = np.asarray(freq, np.uint64)
        if len(self.freq) and int(self.freq.sum()) != 1 << PRECISION:
            raise ValueError("the frequencies do not add up")
        self.first = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        size = int(self.symbols.max()) + 1 if len(self.symbols) else 1
        self.rank = np.full(size, -1, np.int64)
        self.rank[self.symbols] = np.arange(len(self.symbols))
        self.slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))

    @classmethod
    def from_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Counts scaled to 2**PRECISION, at least 1 for each symbol that occurs; the largest take the rounding."""
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols)[order], np.asarray(counts, np.float64)[order]
        if not len(symbols):
            return cls(symbols, np.zeros(0))
        if len(symbols) > 1 << PRECISION:
            raise ValueError("too many symbols for the precision")
        freq = np.maximum(1, np.floor(counts / counts.sum() * (1 << PRECISION))).astype(np.int64)
        rest = (1 << PRECISION) - int(freq.sum())
        if rest > 0:
            freq[np.argmax(freq)] += rest
        while rest < 0:
            k = int(np.argmax(freq))
            take = min(-rest, max(1, int(freq[k]) // 2))
            freq[k] -= take
            rest += take
        return cls(symbols, freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """One block."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    steps = -(-n // lanes)
    rank = table.rank[ids] if n else np.zeros(0, np.int64)
    if n and rank.min() < 0:
        raise ValueError("an id is not in the table")
    common = int(np.argmax(table.freq)) if len(table.freq) else 0
    padded = np.full(steps * lanes, common, np.int64)
    padded[:n] = rank
    padded = padded.reshape(steps, lanes)
    state = np.full(lanes, _LOW, np.uint64)
    chunks: list[np.ndarray] = []
    spilled = 0
    marks: list[tuple[int, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        f = table.freq[padded[t]]
        over = state >= (f << np.uint64(63 - PRECISION))
        if over.any():
            words = (state[over] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1]
            chunks.append(words)
            spilled += len(words)
            state[over] >>= np.uint64(32)
        quotient = state // f
        state = (quotient << np.uint64(PRECISION)) + (state - quotient * f) + table.first[padded[t]]
        if t % every == 0:
            marks.append((spilled, state.copy()))
    stream = np.concatenate(chunks)[::-1] if chunks else np.zeros(0, "<u4")
    marks.reverse()
    body = b"".join(struct.pack("<Q", spilled - at) + s.astype("<u8").tobytes() for at, s in marks) + stream.tobytes()
    fields = (_MAGIC, 1, lanes, every, n, len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()))
    return _HEADER.pack(*fields, zlib.crc32(body, zlib.crc32(_HEADER.pack(*fields, 0)))) + body


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids between checkpoints `first` and `last` (all by default), all parts side by side; checks both checksums."""
    if len(block) < _HEADER.size:
        raise ValueError("the block is cut off")
    *fields, crc = _HEADER.unpack_from(block)
    magic, version, lanes, every, n, count, size, crc_ids = fields
    if magic != _MAGIC or version != 1:
        raise ValueError("not a block of this format")
    body = memoryview(block)[_HEADER.size :]
    if zlib.crc32(body, zlib.crc32(_HEADER.pack(*fields, 0))) != crc:
        raise ValueError("the block is damaged")
    last = count if last is None else min(last, count)
    mark = 8 + 8 * lanes
    stream = np.frombuffer(body, "<u4", size, count * mark)
    stream = np.concatenate([stream, np.zeros(lanes, "<u4")]).astype(np.uint64)
    parts = last - first
    if parts <= 0:
        return np.zeros(0, np.uint32)
    at = np.array([struct.unpack_from("<Q", body, k * mark)[0] for k in range(first, last)], np.int64)
    state = np.stack([np.frombuffer(body, "<u8", lanes, k * mark + 8) for k in range(first, last)]).astype(np.uint64)
    steps = -(-n // lanes)
    out = np.zeros((parts, every, lanes), np.int32)
    mask = np.uint64((1 << PRECISION) - 1)
    for t in range(every):
        live = parts if (last - 1) * every + t < steps else parts - 1
        if not live:
            break
        x = state[:live]
        slot = x & mask
        k = table.slots[slot]
        out[:live, t] = k
        x = table.freq[k] * (x >> np.uint64(PRECISION)) + slot - table.first[k]
        under = x < _LOW
        nth = np.cumsum(under, axis=1)
        place = at[:live, None] + nth - 1
        x = np.where(under, (x << np.uint64(32)) | stream[np.where(under, place, 0)], x)
        at[:live] += nth[:, -1]
        state[:live] = x
    ids = table.symbols[out.reshape(-1)[: max(0, min(n, last * every * lanes) - first * every * lanes)]]
    if first == 0 and last == count and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("the ids differ from those that were written")
    return ids
