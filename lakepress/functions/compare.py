"""Word diffs, heat maps, preserved blocks, fuzzy paragraph copies, code comments, tabular encodings.

Plain functions on one text each; udfs.py runs them over Arrow batches.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np

from lakepress.functions import toon
from lakepress.functions.spans import WHITE

_SPACES = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S, _NOT_S = f"[{_SPACES}]", f"[^{_SPACES}]"
_WORDS = re.compile(f"{_S}+|{_NOT_S}+")
_FENCE, _INLINE = re.compile(r"```.*?```", re.S), re.compile(r"`[^`\n]+`")
_URL = re.compile(rf"\bhttps?://{_NOT_S}+", re.ASCII)

# Fixed values.
DIFF_LIMIT, PREVIEW, MIN_ARRAY = 1_000_000, 96, 8
STOPWORDS = frozenset(
    (
        "a an the is are was were be been being am will would could may might and but or at by in of on to with from as for into over under just very really quite rather also too even "
        "still often usually sometimes here there it its this that these those so than then up down out off about again further once all any both each few more most other some such no nor not only own same"
    ).split()
)
_PRESERVE = [re.compile(p, re.ASCII) for p in (r"\bhttps?://", r"\A\.{0,2}/", r"\b\d+(?:\.\d+){1,3}\b", r"\b[A-Za-z_][\w$]*(?:\.[\w$]+)+\b", r"\A`.*`\Z", r"\A\d{3,}\Z")]
_KEPT_COMMENT = re.compile(rf"^#!|#{_S}*(?:noqa|eslint|tslint|prettier-ignore|type:{_S}*ignore|region|endregion)|ERROR|WARN|Error:|Exception:|https?://")


def words(text: str) -> list[str]:
    """Runs of white space and of anything else; together they are the text."""
    return _WORDS.findall(text)


def diff(before: str, after: str) -> list[tuple[str, str]] | None:
    """Segments (same, removed or added; text) of a longest common subsequence; None where the product of sizes is over the limit."""
    a, b = words(before), words(after)
    if len(a) * len(b) > DIFF_LIMIT:
        return None
    out: list[tuple[str, list[str]]] = []

    def put(kind: str, word: str) -> None:
        if out and out[-1][0] == kind:
            out[-1][1].append(word)
        else:
            out.append((kind, [word]))

    # One number for each suffix of a: its k lowest bits have a zero for each word that this suffix shares with the last k words of b.
    n, m = len(a), len(b)
    places: dict[str, int] = {}
    for k, w in enumerate(reversed(b)):
        places[w] = places.get(w, 0) | 1 << k
    every = (1 << m) - 1
    shared = [every] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest = shared[i + 1]
        hit = rest & places.get(a[i], 0)
        shared[i] = (rest + hit | rest - hit) & every
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            put("same", a[i])
            i, j = i + 1, j + 1
            continue
        left = (1 << (m - j)) - 1
        if (shared[i] & left).bit_count() == (shared[i + 1] & left).bit_count():  # as much is shared without this word
            put("removed", a[i])
            i += 1
        else:
            put("added", b[j])
            j += 1
    for kind, tail in (("removed", a[i:]), ("added", b[j:])):
        for w in tail:
            put(kind, w)
    return [(kind, "".join(ws)) for kind, ws in out]


def heatmap(before: str, after: str, mode: str = "ultra") -> list[tuple[str, float, bool | None]]:
    """(token, score, kept) for each token; kept is None where the diff was left out."""
    return heat_of(before, diff(before, after), mode)


@functools.lru_cache(1 << 14)
def _score(token: str) -> float:
    bare = token.strip(WHITE)
    return 1.0 if any(p.search(bare) for p in _PRESERVE) else 0.15 if bare.lower() in STOPWORDS else 0.4 + min(len(bare) / 40, 0.2)


def heat_of(before: str, segments: list[tuple[str, str]] | None, mode: str = "ultra") -> list[tuple[str, float, bool | None]]:
    """The heat map from a diff of the text that is there already."""
    tokens = words(before)
    kept: list[bool | None] = [None] * len(tokens)
    if segments is not None:
        kept = []
        for kind, text in segments:
            if kind != "added":
                kept += [kind == "same"] * len(words(text))
    if mode == "universal":
        return [(token, 1.0 if k else 0.0, k) for token, k in zip(tokens, kept)]
    scores = {token: _score(token) if len(token) <= 64 else _score.__wrapped__(token) for token in set(tokens)}
    return list(zip(tokens, map(scores.__getitem__, tokens), kept))


def preserved(text: str) -> list[tuple[str, str]]:
    """(kind, preview) of fenced code, then inline code, then URLs that do not overlap those before."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern in (("code-block", _FENCE), ("inline-code", _INLINE), ("url", _URL)):
        for m in pattern.finditer(text):
            if kind != "code-block" and any(m.start() < e and m.end() > s for s, e in taken):
                continue
            taken.append(m.span())
            flat = re.sub(f"{_S}+", " ", m[0]).strip(WHITE)
            wide = utf16(flat)
            out.append((kind, flat if len(wide) <= PREVIEW else plain(wide[: PREVIEW - 1]) + "…"))
    return out


def utf16(text: str) -> str:
    """A character for each UTF-16 code unit."""
    return text if text.isascii() or max(text) < "\U00010000" else "".join(map(chr, np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()))


def plain(units: str) -> str:
    """Back again; half a character at the end goes."""
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "ignore")


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: differences of a whole column of the table at once, as bits of two long numbers."""
    if abs(len(a) - len(b)) > edits:
        return False
    if not a or not b:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, distance = every, 0, len(a)  # where the column grows or falls by one, and its last number
    for j, c in enumerate(b, 1):
        match = places.get(c, 0)
        along = match | less
        match |= (((match & more) + more) ^ more) & every
        grows, falls = (less | ~(match | more)) & every, more & match
        distance += bool(grows & top) - bool(falls & top)
        if distance - (len(b) - j) > edits:
            return False
        grows, falls = (grows << 1 | 1) & every, falls << 1 & every
        more, less = (falls | ~(along | grows)) & every, grows & along
    return distance <= edits


_RUN, _RUN_BITS, _MOST_FUZZY = 3, 12, 2_000


def _runs(text: str) -> np.ndarray:
    """How many runs of three code units fall on each of 2**12 places."""
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    if len(codes) < _RUN:
        return np.zeros(1 << _RUN_BITS, np.int16)
    h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + codes[2:]
    return np.bincount(((h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - _RUN_BITS)).astype(np.int64), minlength=1 << _RUN_BITS).astype(np.int16)


def drop_similar_blocks(text: str, fuzzy: bool = True) -> tuple[str, int]:
    """Paragraphs that equal, or nearly equal, one that was kept go; a worded marker ends the text.

    Texts within k edits share all but 3 k of their runs of three; kept paragraphs with fewer are not compared.
    """
    blocks = text.split("\n\n")
    if len(blocks) < 2:
        return text, 0
    fuzzy = fuzzy and len(blocks) <= 400
    kept: list[str] = []
    known: set[str] = set()
    near: list[tuple[str, int]] = []  # kept paragraphs that others are compared with: normal form, and length as written; and their runs
    runs = np.zeros((0, 1 << _RUN_BITS), np.int16)
    for block in blocks:
        own = re.sub(f"{_S}+", " ", block.lower()).strip(WHITE)
        wide = utf16(own)
        if len(wide) >= 80 and own in known:
            continue
        size = len(utf16(block))
        mine = _runs(wide) if fuzzy and (size <= _MOST_FUZZY or 80 <= len(wide) <= _MOST_FUZZY) else None
        if fuzzy and 80 <= len(wide) <= _MOST_FUZZY:
            shared = np.minimum(runs[: len(near)], mine).sum(1, dtype=np.int32).tolist()
            if any((edits := int((1 - 0.9) * max(len(wide), n))) > 0 and have >= max(len(wide), len(x)) - 2 - _RUN * edits and within(wide, x, edits) for (x, n), have in zip(near, shared)):
                continue
        kept.append(block)
        known.add(own)
        if fuzzy and size <= _MOST_FUZZY:
            if len(near) == len(runs):
                runs = np.concatenate([runs, np.zeros((max(8, len(runs)), runs.shape[1]), np.int16)])
            runs[len(near)] = mine
            near.append((wide, size))
    removed = len(blocks) - len(kept)
    if not removed:
        return text, 0
    from lakepress.functions.text import COUNT_WORDS

    count = f"{COUNT_WORDS[removed - 1]} " if removed <= len(COUNT_WORDS) else ""
    return "\n\n".join(kept) + f"\n\n[… {count}duplicate block{'' if removed == 1 else 's'} elided …]", removed


def strip_comments(text: str) -> str:
    """Full-line comments in fenced code go, but for directives, severities and URLs; the fence's own lines stay."""

    def inside(m: re.Match) -> str:
        lines = m[0].split("\n")
        return "\n".join(x for k, x in enumerate(lines) if k in (0, len(lines) - 1) or not x.lstrip().startswith(("#", "//")) or _KEPT_COMMENT.search(x.lstrip()))

    return _FENCE.sub(inside, text)


def _number(digits: str) -> int | float:
    """A whole number is written without a fraction, as in the scripts that such arrays come from."""
    value = float(digits)
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def arrays(text: str) -> list[list[dict]]:
    """Arrays of at least 8 objects in lines that begin with [ or in fenced JSON; each text of one counts once."""
    found = [y for x in text.split("\n") if (y := x.strip(WHITE)).startswith("[")]
    found += [m[1].strip(WHITE) for m in re.finditer(rf"```json{_S}*(.*?)```", text, re.S)]
    out = []
    for candidate in dict.fromkeys(found):
        try:
            value = json.loads(candidate, parse_float=_number, parse_constant=_refuse)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, list) and len(value) >= MIN_ARRAY and all(isinstance(x, dict) for x in value):
            out.append(value)
    return out


def compact_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _scalar(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value) if isinstance(value, (str, int, float)) else compact_json(value)


def _csv(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if re.search(r'[",\n\r]', value) else value


def tabular(rows: list[dict]) -> str:
    """A fenced table: type hints, column names, a line for each row, the number of rows."""
    columns = list(dict.fromkeys(k for row in rows for k in row))

    def hint(value: object) -> str:
        return "s" if isinstance(value, str) else "b" if isinstance(value, bool) else "n" if isinstance(value, (int, float)) else "j"

    hints = [next((hint(r[c]) for r in rows if r.get(c) is not None), "null") for c in columns]
    cells = [[("null" if h == "j" else "") if r.get(c) is None else compact_json(r[c]) if h == "j" else _scalar(r[c]) for c, h in zip(columns, hints)] for r in rows]
    body = [",".join(_csv(x) for x in row) for row in cells]
    return "\n".join(["```omni-tabular", ",".join(hints), ",".join(_csv(c) for c in columns), *body, f"[{len(rows)} rows]", "```"])


FORMS: dict[str, Callable[[list[dict]], str]] = {"json": compact_json, "gcf": tabular, "toon": toon.encode}


def encodings(text: str) -> dict:
    """Bytes and tokens of all arrays as JSON, as a table and as TOON, and the smallest by tokens, then bytes, then that order.

    A form that can't hold an array, nested too deep for it, has none.
    """
    found = arrays(text)
    out: dict = {"arrays": len(found)}
    for name, form in FORMS.items():
        try:
            own = [len(form(a).encode()) for a in found]
        except RecursionError:
            out |= {f"{name}_bytes": None, f"{name}_tokens": None}
        else:
            out |= {f"{name}_bytes": sum(own), f"{name}_tokens": sum(-(-n // 4) for n in own)}
    usable = [k for k in FORMS if out[f"{k}_bytes"] is not None]
    out["winner"] = min(usable, key=lambda k: (out[f"{k}_tokens"], out[f"{k}_bytes"]), default="json")
    return out
