"""Values as text in the public TOON notation: indented keys, counted arrays, tables for uniform objects.

Objects with the same keys and no nested values become a table, arrays of plain values one
line, all else a list. Written from the notation's published rules; two blanks a level, commas between values.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

_STEP = "  "
_BARE_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_NUMERIC = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\Z", re.ASCII)
_SPECIAL = re.compile(r'[,:"\\\[\]{}\x00-\x1f]')


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _key(name: str) -> str:
    return name if _BARE_KEY.match(name) else _quoted(name)


def plain(value: object) -> str:
    """A value that holds no others; numbers without exponents, strings in quotes where they could be taken for something else."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else format(Decimal(repr(value)), "f")
    text = str(value)
    bare = text and text == text.strip() and not text.startswith("-") and text not in ("true", "false", "null")
    return text if bare and not _SPECIAL.search(text) and not _NUMERIC.match(text) else _quoted(text)


def _nested(value: object) -> bool:
    return isinstance(value, (dict, list))


def _columns(rows: list) -> list[str] | None:
    """The keys that all rows share, if they are objects of plain values with the same ones."""
    if not rows or not all(isinstance(r, dict) and r and r.keys() == rows[0].keys() for r in rows):
        return None
    return None if any(_nested(v) for r in rows for v in r.values()) else list(rows[0])


def _array(name: str, values: list, level: int) -> Iterator[tuple[int, str]]:
    head = f"{name}[{len(values)}]"
    if not any(_nested(v) for v in values):
        yield level, f"{head}: {','.join(plain(v) for v in values)}" if values else f"{head}:"
    elif columns := _columns(values):
        yield level, f"{head}{{{','.join(_key(c) for c in columns)}}}:"
        for row in values:
            yield level + 1, ",".join(plain(row[c]) for c in columns)
    else:
        yield level, f"{head}:"
        for value in values:
            yield from _item(value, level + 1)


def _item(value: object, level: int) -> Iterator[tuple[int, str]]:
    """One of a list: the first line after a hyphen, the rest of an object below it."""
    if isinstance(value, dict):
        lines = list(_object(value, level + 1))
        yield level, f"- {lines[0][1]}" if lines else "-"
        yield from lines[1:]
    elif isinstance(value, list):
        (_, head), *rest = _array("", value, level)
        yield level, f"- {head}"
        yield from rest
    else:
        yield level, f"- {plain(value)}"


def _object(value: dict, level: int) -> Iterator[tuple[int, str]]:
    for name, own in value.items():
        if isinstance(own, list):
            yield from _array(_key(name), own, level)
        elif isinstance(own, dict):
            yield level, f"{_key(name)}:"
            yield from _object(own, level + 1)
        else:
            yield level, f"{_key(name)}: {plain(own)}"


def encode(value: object) -> str:
    if isinstance(value, dict):
        lines = _object(value, 0)
    elif isinstance(value, list):
        lines = _array("", value, 0)
    else:
        return plain(value)
    return "\n".join(_STEP * level + line for level, line in lines)
