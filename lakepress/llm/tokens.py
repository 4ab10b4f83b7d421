"""Token ids of whole texts by the `tokenizers` library, fast on text that repeats its words.

Byte-level BPE works on the pieces of its splitting pattern one by one, so a
text may be cut wherever such a piece surely begins: before ASCII white space
that follows a character that is not white space, and before ASCII punctuation
that follows an ASCII letter or digit.  Each distinct cut is encoded once by
the library and kept in the Python worker with its bytes; a cut is found again
by a 64-bit hash, its bytes are then compared, and one that only shares the hash
is encoded by itself.  Texts are put together from kept ids by array
operations.  Where the character before a cut might be Unicode white space,
nothing is cut.

The strings of special tokens are ordinary text, as the vocabulary files' own
README sets it (`encode_special_tokens`): a document must not write an end id by
spelling it.  With `specials=True` they become their ids; a text that holds one is
then encoded whole.  No special token is added.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from lakepress.llm.bytesops import HashIndex, groups, hash_spans

#: Distinct cuts, and bytes of them, that a worker keeps; beyond either the table begins anew. They bound memory, not results.
KEPT_CUTS, KEPT_BYTES = 1 << 19, 16 << 20
#: A longer text is encoded in runs of cuts of about so many bytes.
RUN_BYTES = 4 << 20

#: What a byte may be, as bits: white space to cut before; any white space or a separator control; ASCII letter or digit;
#: ASCII punctuation to cut before; part of a longer character; last byte of U+0085 or U+00A0; lead of white space of three bytes.
_CUT, _BLANK, _ALNUM, _PUNCT, _HIGH, _DOUBT, _LEAD = (np.uint8(1 << k) for k in range(7))
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 13, 32]] |= _CUT
_KIND[[*range(9, 14), *range(28, 33)]] |= _BLANK
_KIND[33:127] |= _PUNCT
for _span in (slice(48, 58), slice(65, 91), slice(97, 123)):
    _KIND[_span] = _ALNUM
_KIND[39] = 0
_KIND[128:] |= _HIGH
_KIND[[0x85, 0xA0]] |= _DOUBT
_KIND[0xE1:0xE4] |= _LEAD

#: Bytes that only letters up to U+023F have, when the two signs among them are looked for apart.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:0xC0] = _LETTER[0xC3:0xC9] = True

#: How byte-level BPE writes each byte as a printable character: those that print in Latin-1 as they are, the rest from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte positions at which the texts may be cut, their own beginnings included."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        kind = _KIND[data]
        prev, here = kind[:-1], kind[1:]
        bad = prev & (_BLANK | _DOUBT)  # no cut after white space or what may be its last byte
        if n > 3:
            bad[2:] |= (kind[:-3] & _LEAD) * ((prev[2:] & _HIGH) != 0)
        cut[1:n] = ((here & _CUT != 0) & (bad == 0)) | ((here & _PUNCT != 0) & (prev & _ALNUM != 0))
    cut[offsets[:-1]] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of batches of texts; keeps the ids of the cuts it has met."""

    def __init__(self, path: str, specials: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Strings that a cut must not divide: a text with one goes to the library whole.
        self.whole = [t.content.encode() for t in added if specials or not t.special]
        own = self.tokenizer.pre_tokenizer
        #: One run of letters, with a space before it or not, is one piece of byte-level BPE and can go to the model as it is.
        self.direct = self.tokenizer.normalizer is None and type(own).__name__ == "ByteLevel" and own.use_regex and not own.add_prefix_space
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex(16)
        self.at = np.zeros(1, np.int64)  # the ids of cut k are ids[at[k]:at[k + 1]], its bytes are held[held_at[k]:held_at[k + 1]]
        self.ids = np.zeros(0, np.uint32)
        self.held_at = np.zeros(1, np.int64)
        self.held = np.zeros(0, np.uint8)

    def _tokenized(self, own: np.ndarray, to: np.ndarray) -> list[list[int]]:
        """The library's ids of the cuts own[to[k]:to[k + 1]]."""
        odd = ~_LETTER[own]
        odd[1:] |= (own[:-1] == 0xC3) & ((own[1:] == 0x97) | (own[1:] == 0xB7))
        odd[to[:-1]] &= own[to[:-1]] != 32
        letters = (np.add.reduceat(odd, to[:-1]) == 0) & ((np.diff(to) > 1) | (own[to[:-1]] != 32)) if self.direct else np.zeros(len(to) - 1, bool)
        printed = own.tobytes().decode("latin-1").translate(_BYTE_CHARS)
        model = self.tokenizer.model.tokenize
        spans = list(zip(to[:-1].tolist(), to[1:].tolist(), letters.tolist()))
        later = [own[i:j].tobytes().decode("utf-8", "replace") for i, j, plain in spans if not plain]
        slow = (x.ids for x in self.tokenizer.encode_batch_fast(later, add_special_tokens=False)) if later else iter(())
        return [[x.id for x in model(printed[i:j])] if plain else next(slow) for i, j, plain in spans]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        sizes = ends - starts
        to = np.concatenate([[0], np.cumsum(sizes)])
        own = data[np.arange(to[-1]) + np.repeat(starts - to[:-1], sizes)]  # the new cuts, one after the other
        found = self._tokenized(own, to)
        counts = [len(x) for x in found]
        parts = [y for x in found for y in x]
        self.index.insert(hashes)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.asarray(counts, np.int64))])
        self.ids = np.concatenate([self.ids, np.asarray(parts, np.uint32)])
        self.held = np.concatenate([self.held, own])
        self.held_at = np.concatenate([self.held_at, self.held_at[-1] + to[1:]])

    def _strangers(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cuts whose bytes differ from those of the kept cut with their hash; all cuts together are `data`."""
        sizes = self.held_at[rows + 1] - self.held_at[rows]
        odd = sizes != ends - starts
        if odd.any():
            sizes = np.where(odd, 0, sizes)
        first = np.cumsum(sizes) - sizes
        total = int(first[-1] + sizes[-1])
        place = np.arange(total) - np.repeat(first, sizes)
        same = self.held[place + np.repeat(self.held_at[rows], sizes)] == (data if not odd.any() else data[place + np.repeat(starts, sizes)])
        if not same.all():
            odd[np.searchsorted(first, np.flatnonzero(~same), "right") - 1] = True
        return np.flatnonzero(odd)

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts that lie side by side (data[0] is the first one's), and how many each has."""
        hashes = hash_spans(data, starts, ends)
        rows = self.index.lookup(hashes)
        if (rows < 0).any():
            missing = np.flatnonzero(rows < 0)
            new, where = np.unique(hashes[missing], return_index=True)
            more = int((ends - starts)[missing[where]].sum())
            if self.index.size and (self.index.size + len(new) > KEPT_CUTS or len(self.held) + more > KEPT_BYTES):
                self._clear()
                missing = np.arange(len(hashes))
                new, where = np.unique(hashes, return_index=True)
            self._learn(new, data, starts[missing[where]], ends[missing[where]])
            rows = self.index.lookup(hashes)
        sizes = self.at[rows + 1] - self.at[rows]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.at[rows] - total[:-1], sizes)]
        strangers = self._strangers(rows, data, starts, ends)
        if len(strangers):
            parts = np.split(ids, total[1:-1])
            for k in strangers.tolist():
                own = data[starts[k] : ends[k]]
                parts[k] = np.asarray(self._tokenized(own, np.array([0, len(own)]))[0], np.uint32)
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and bounds of texts that no string of `whole` is in."""
        docs = len(offsets) - 1
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not len(filled):
            return np.zeros(0, np.uint32), np.zeros(docs + 1, np.int64)
        starts = cut_starts(data, np.append(offsets[filled], len(data)))
        ends = np.append(starts[1:], len(data))
        parts, counts, k = [], [], 0
        while k < len(starts):
            to = max(k + 1, int(np.searchsorted(ends, starts[k] + RUN_BYTES, "right")))
            ids, sizes = self._run(data[starts[k] : ends[to - 1]], starts[k:to] - starts[k], ends[k:to] - starts[k])
            parts.append(ids)
            counts.append(sizes)
            k = to
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(parts), total[np.searchsorted(starts, offsets)]

    def _holding(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts with a string of `whole`."""
        found: set[int] = set()
        raw = data.tobytes() if self.whole else b""
        for sign in self.whole:
            at = raw.find(sign)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(sign) <= offsets[k + 1]:
                    found.add(k)
                    at = raw.find(sign, int(offsets[k + 1]))
                else:
                    at = raw.find(sign, at + 1)
        return sorted(found)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the n + 1 places where each text's begin; `end_id` closes each text."""
        docs = len(offsets) - 1
        offsets = np.asarray(offsets, np.int64)
        if holding := self._holding(data, offsets):
            parts = []
            for k in range(docs):
                own = data[offsets[k] : offsets[k + 1]]
                parts.append(np.asarray(self.tokenizer.encode(own.tobytes().decode(), add_special_tokens=False).ids, np.uint32) if k in holding else self._cut(own, np.array([0, len(own)]))[0])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        else:
            ids, bounds = self._cut(data, offsets)
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(docs + 1)
        return ids, bounds


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file; made once, for it takes long to load."""
    if (path, specials) not in _encoders:
        _encoders[path, specials] = Encoder(path, specials)
    return _encoders[path, specials]


def encode_column(column: pa.Array, path: str, end_id: int | None, specials: bool = False):
    """For runs of rows: first row, end row, ids, bounds."""
    own = encoder(path, specials)
    for i, j, data, offsets in groups(column):
        ids, bounds = own.encode(data, offsets, end_id)
        yield i, j, ids, bounds
