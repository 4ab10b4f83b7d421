"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Values are found by their format and validated (card numbers by Luhn, IBANs by
modulus 97, dates by the calendar in either order of day and month, social security
numbers by their numbering plan, addresses by octets). Telephone numbers are taken as
written: ten digits in American form, or 8 to 15 after +, where the country's code stays.  A valid value is a number below N,
the count of valid values of its kind and format; an unbalanced Feistel network
of ten rounds over a x b >= N, walked until the result is below N, permutes them,
with the kind, the format and the key as the round function's input.  So a
pseudonym is again valid and written the same way, different values keep
different pseudonyms, and equal values have equal ones in all documents.
restore() is the inverse for the holder of the key.

Kinds: card, iban, phone, ssn, ip, date (also before a time of day), email (letters and digits
of the local part, each within its kind), key (access key ids), secret (hexadecimal values after
password, token, secret or key). Cards and IBANs are looked for in runs of groups of digits or
characters: from each group on, the longest run of groups that validates and is written as such a
value is, so what follows or precedes one does not hide it. Values that overlap: the first that begins, and of
those the kind first in that list. What does not validate stays, as do telephone
numbers of other countries without +, and dates outside 1900 to 2099.

A null text stays null and counts as empty; rows that repeat are treated alike;
an empty table gives an empty result. Texts are read whole; other columns are not read.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm import common

ROUNDS = 10
SCHEMA = "doc_id long, text string, n_found long, kinds string"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_EPOCH, _DAYS = datetime.date(1900, 1, 1), 73_049  # 1900-01-01 to 2099-12-31
_LATE = [k for k in range(_DAYS) if (_EPOCH + datetime.timedelta(days=k)).day > 12]
#: Country codes of one and two digits; all others have three.
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Feistel:
    """A keyed permutation of the numbers below any N."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, x: int) -> int:
        data = tweak + b"\0" + bytes([i]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if not 0 <= x < n:
            raise ValueError("not a value of this kind")
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        sides = (a, -(-n // a))
        label = f"{tweak}/{n}".encode()
        while True:  # the walk ends, as the network permutes a x b values and x was below n
            left, right = divmod(x, sides[1])
            for i in range(ROUNDS)[:: -1 if back else 1]:
                sign = -1 if back else 1
                if i % 2 == 0:
                    left = (left + sign * self._round(label, i, right)) % sides[0]
                else:
                    right = (right + sign * self._round(label, i, left)) % sides[1]
            x = left * sides[1] + right
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_rest(body: str, country: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _write(pattern: str, digits: str, alphabet: str = _DIGITS) -> str:
    """`digits` in the places that characters of the alphabet have in `pattern`."""
    it = iter(digits)
    return "".join(next(it) if c in alphabet else c for c in pattern)


def _by_class(value: str, classes: tuple[str, ...] = (_DIGITS, _UPPER, _LOWER)) -> tuple[int, int, Callable[[int], str]]:
    """A string as a number among those with the same classes of characters at the same places."""
    sets = [next((s for s in classes if c in s), c) for c in value]
    n, x = 1, 0
    for c, s in zip(value, sets):
        n, x = n * len(s), x * len(s) + s.index(c)

    def back(y: int) -> str:
        out = []
        for s in reversed(sets):
            y, k = divmod(y, len(s))
            out.append(s[k])
        return "".join(reversed(out))

    return n, x, back


Coded = tuple[int, int, Callable[[int], str]]  # how many values, which one this is, and how one is written


def _card(text: str) -> Coded | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    size = len(digits) - 2  # the first digit names the network and stays
    return 10**size, int(digits[1:-1]), lambda y: _write(text, (d := digits[0] + str(y).zfill(size)) + str(luhn(d)))


def _iban(text: str) -> Coded | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain[4:], plain[:2]) != 98 - int(plain[2:4]):
        return None
    n, x, back = _by_class(plain[4:])

    def write(y: int) -> str:
        body = back(y)
        return _write(text, plain[:2] + f"{98 - _iban_rest(body, plain[:2]):02d}" + body, _DIGITS + _UPPER)

    return n, x, write


def _phone(text: str) -> Coded:
    digits = re.sub(r"\D", "", text)
    head, own = digits[:-10], digits[-10:]
    return 10**10, int(own), lambda y: _write(text, f"{head}{y:010d}")


def _abroad(text: str) -> Coded | None:
    """A number with + before it: the country's code stays."""
    digits = re.sub(r"\D", "", text)
    code = next(k for k in (1, 2, 3) if k == 3 or digits[:k] in _CALLING)
    size = len(digits) - code
    if not 8 <= len(digits) <= 15:
        return None
    return 10**size, int(digits[code:]), lambda y: _write(text, digits[:code] + str(y).zfill(size))


def _ssn(text: str) -> Coded | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9_999 + serial - 1

    def write(y: int) -> str:
        y, c = divmod(y, 9_999)
        a, b = divmod(y, 99)
        return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"

    return 898 * 99 * 9_999, x, write


def _ip(text: str) -> Coded | None:
    """Octets up to 255; one that is written with zeros before it keeps its length and a zero at the front."""
    parts = text.split(".")
    if max(int(p) for p in parts) > 255:
        return None
    sizes = [10 ** (len(p) - 1) if len(p) > 1 and p[0] == "0" else 256 for p in parts]
    n, x = 1, 0
    for p, size in zip(parts, sizes):
        n, x = n * size, x * size + int(p)

    def write(y: int) -> str:
        out = []
        for p, size in zip(parts[::-1], sizes[::-1]):
            y, k = divmod(y, size)
            out.append(str(k) if size == 256 else str(k).zfill(len(p)))
        return ".".join(reversed(out))

    return n, x, write


def _date(text: str) -> Coded | None:
    """A day of 1900 to 2099; where day and month are only valid in the other order, one of those whose day is over 12."""
    a, b, c = (int(p) for p in re.split(r"\D", text))
    mark = next(m for m in text if not m.isdigit())
    usual, swapped = ((a, b, c), None) if mark == "-" else ((c, b, a), (c, a, b)) if mark == "." else ((c, a, b), (c, b, a))
    for other, parts in enumerate((usual, swapped)):
        try:
            day = datetime.date(*parts) if parts else None
        except ValueError:
            continue
        if day is None or not 0 <= (x := (day - _EPOCH).days) < _DAYS:
            return None
        form = "%Y-%m-%d" if mark == "-" else f"%d{mark}%m{mark}%Y" if (mark == ".") != bool(other) else f"%m{mark}%d{mark}%Y"
        if other:
            return len(_LATE), bisect.bisect_left(_LATE, x), lambda y: (_EPOCH + datetime.timedelta(days=_LATE[y])).strftime(form)
        return _DAYS, x, lambda y: (_EPOCH + datetime.timedelta(days=y)).strftime(form)
    return None


def _email(text: str) -> Coded | None:
    local, _, domain = text.rpartition("@")
    n, x, back = _by_class(local)
    return (n, x, lambda y: f"{back(y)}@{domain}") if n > 1 else None


def _key(text: str) -> Coded | None:
    n, x, back = _by_class(text[4:])
    return n, x, lambda y: text[:4] + back(y)


def _secret(text: str) -> Coded | None:
    """Hexadecimal digits in lower case as a number; with upper case, every letter stays one of its case."""
    if text == text.lower():
        return 16 ** len(text), int(text, 16), lambda y: f"{y:x}".zfill(len(text))
    return _by_class(text, (_DIGITS, "abcdef", "ABCDEF"))


Found = tuple[int, int, str]  # start, end, value


def _matches(pattern: str) -> Callable[[str], Iterator[Found]]:
    """All matches; the value is group 1."""
    compiled = re.compile(pattern)
    return lambda text: ((m.start(1), m.end(1), m[1]) for m in compiled.finditer(text))


def _grouped(runs: str, group: str, begins: str, fits: Callable[[list[int]], bool], valid: Callable[[str], object]) -> Callable[[str], Iterator[Found]]:
    """Values inside runs of groups: from each group that `begins` one on, the longest whose sizes fit and that is valid."""
    run_of, group_of, begin = re.compile(runs), re.compile(group), re.compile(begins)

    def find(text: str) -> Iterator[Found]:
        for m in run_of.finditer(text):
            spans = [g.span() for g in group_of.finditer(text, m.start(), m.end())]
            k = 0
            while k < len(spans):
                last = None
                if begin.match(text, spans[k][0]):
                    for j in range(min(len(spans), k + 10) - 1, k - 1, -1):
                        value = text[spans[k][0] : spans[j][1]]
                        if fits([b - a for a, b in spans[k : j + 1]]) and valid(value):
                            last = j
                            yield spans[k][0], spans[j][1], value
                            break
                k = k + 1 if last is None else last + 1

    return find


# How card numbers are divided.
_CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3), (6, 13)}


def _as_card(sizes: list[int]) -> bool:
    return tuple(sizes) in _CARD_GROUPS if len(sizes) > 1 else 13 <= sizes[0] <= 19


def _as_iban(sizes: list[int]) -> bool:
    """One group, or groups of four and a last one of at most four."""
    return 15 <= sum(sizes) <= 34 and (len(sizes) == 1 or (all(n == 4 for n in sizes[:-1]) and sizes[-1] <= 4))


#: Kind, what finds its values, and how a value is coded.
KINDS: list[tuple[str, Callable[[str], Iterator[Found]], Callable[[str], Coded | None]]] = [
    ("card", _grouped(r"(?<![\w.-])\d+(?:[ -]\d+)*(?![\w-])", r"\d+", r"\d", _as_card, _card), _card),
    ("iban", _grouped(r"(?<!\w)[A-Z0-9]+(?: [A-Z0-9]+)*(?!\w)", r"[A-Z0-9]+", r"[A-Z]{2}\d{2}", _as_iban, _iban), _iban),
    ("phone", _matches(r"(?<![\w(+-])((?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])"), _phone),
    ("phone", _matches(r"(?<![\w(+-])(\+[1-9]\d{0,2}(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,14})){1,6})(?![\w@-])"), _abroad),
    ("ssn", _matches(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"), _ssn),
    ("ip", _matches(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"), _ip),
    ("date", _matches(r"(?<![\w./-])(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?:(?=T\d{2}:\d{2})|(?![\w/-]|\.\d))"), _date),
    ("email", _matches(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"), _email),
    ("key", _matches(r"(?<!\w)((?:AKIA|ASIA)[A-Z0-9]{16})(?!\w)"), _key),
    ("secret", _matches(r"(?i:password|passwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?([0-9a-fA-F]{16,128})(?![0-9A-Za-z])"), _secret),
]
_ANY_DIGIT = re.compile(r"\d")


class Pseudonyms:
    """Finds and replaces values of all kinds with one key."""

    def __init__(self, key: bytes, kinds: list[str] | None = None):
        self.feistel = Feistel(key)
        self.kinds = [k for k in KINDS if kinds is None or k[0] in kinds]

    def find(self, text: str) -> list[tuple[int, int, str, Coded]]:
        """Start, end, kind and coding of the values, which do not overlap."""
        has_digit, has_at = bool(_ANY_DIGIT.search(text)), "@" in text
        found = []
        for rank, (kind, values, code) in enumerate(self.kinds):
            if not (has_at if kind == "email" else has_digit or kind in ("key", "secret")):
                continue
            for start, end, value in values(text):
                if coded := code(value):
                    found.append((start, rank, end, kind, coded))
        out, free = [], 0
        for start, _, end, kind, coded in sorted(found, key=lambda x: x[:2]):
            if start >= free:
                out.append((start, end, kind, coded))
                free = end
        return out

    def replace(self, text: str, back: bool = False) -> tuple[str, list[str]]:
        """The text with pseudonyms (or, `back`, with the values again), and the kinds that were found, in order."""
        parts, at, kinds = [], 0, []
        for start, end, kind, (n, x, write) in self.find(text):
            shape = kind if kind in ("phone", "ssn", "ip", "date") else f"{kind}{n}"
            parts += [text[at:start], write(self.feistel.permute(x, n, shape, back))]
            kinds.append(kind)
            at = end
        return "".join(parts) + text[at:], kinds


def _rewritten(docs: DataFrame, key: bytes, back: bool) -> DataFrame:
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text in batch.column(1).to_pylist():
                new, found = own.replace(text or "", back)
                texts.append(None if text is None else new)
                counts.append(len(found))
                kinds.append(",".join(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_found", "kinds"])

    return rows.mapInArrow(common.trimmed(run), SCHEMA)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds (comma-joined, in order) for each row; no exchange."""
    return _rewritten(docs, key, False)


def restore(docs: DataFrame, key: bytes) -> DataFrame:
    """The inverse of pseudonymise() with the same key."""
    return _rewritten(docs, key, True)
