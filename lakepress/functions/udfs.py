"""The functions that built-in expressions can't say, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepress.functions import compare, prose, spans

# Types as objects, so that this module can be imported before a session exists.
_TEXT, _LONG = T.StringType(), T.LongType()
_TEXTS = T.ArrayType(_TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_CONDENSED = _struct(output=_TEXT, skipped=_TEXT, techniques=_TEXTS, rules=_TEXTS)


def condense(text: Column, intensity: str) -> Column:
    @F.pandas_udf(_CONDENSED)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [prose.Condensed(None, "null") if t is None else prose.condense(t, intensity) for t in s]
        return pd.DataFrame({"output": [r.output for r in rows], "skipped": [r.skipped for r in rows], "techniques": [r.techniques for r in rows], "rules": [r.rules for r in rows]})

    return run(text)


def drop_similar_blocks(text: Column, fuzzy: bool = True) -> Column:
    @F.pandas_udf(_struct(output=_TEXT, removed=_LONG))
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, 0) if t is None else compare.drop_similar_blocks(t, fuzzy) for t in s]
        return pd.DataFrame(rows, columns=["output", "removed"])

    return run(text)


@F.pandas_udf(_TEXT)
def strip_comments(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else compare.strip_comments(t))


@F.pandas_udf(_TEXT)
def infidelity(before: pd.Series, after: pd.Series) -> pd.Series:
    """Why a step is not faithful; null where it is."""
    return pd.Series([None if a is None or b is None else spans.infidelity(a, b) for a, b in zip(before, after)], dtype=object)


@F.pandas_udf(_TEXTS)
def critical_needles(s: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else [x for _, x in spans.facts(t)[0]] for t in s], dtype=object)


@F.pandas_udf(_struct(text=_TEXT, vals=_TEXTS, categories=T.MapType(_TEXT, _LONG)))
def lock(s: pd.Series) -> pd.DataFrame:
    rows = [(None, [], {}) if t is None else spans.lock(t) for t in s]
    return pd.DataFrame({"text": [r[0] for r in rows], "vals": [r[1] for r in rows], "categories": [r[2] for r in rows]})


@F.pandas_udf(_TEXT)
def unlock(s: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else spans.unlock(t, list(v)) for t, v in zip(s, values)], dtype=object)


@F.pandas_udf(_struct(text=_TEXT, vals=_TEXTS, kinds=_TEXTS, reject=_TEXT))
def mask(s: pd.Series) -> pd.DataFrame:
    out = []
    for t in s:
        risk = None if t is None else spans.document_risk(t)
        text, values = (t, []) if t is None or risk else spans.mask(t)
        out.append((text, [v for _, v in values], [k for k, _ in values], risk and f"risk:{risk}"))
    return pd.DataFrame(out, columns=["text", "vals", "kinds", "reject"])


@F.pandas_udf(_TEXT)
def unmask(s: pd.Series, values: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else spans.unmask(t, list(zip(k, v))) for t, v, k in zip(s, values, kinds)], dtype=object)


_SEGMENTS, _HEAT = T.ArrayType(_struct(type=_TEXT, text=_TEXT)), T.ArrayType(_struct(text=_TEXT, score=T.DoubleType(), kept=T.BooleanType()))
#: Rows whose words are laid out at a time.
_ROWS = 256


def _lists(rows: list[list[tuple] | None], fields: dict[str, pa.DataType]) -> pa.Array:
    """Lists of structs from tuples, column by column; None is a null list."""
    ends = [0, *accumulate(len(r or ()) for r in rows)]
    columns = list(zip(*(x for r in rows if r for x in r))) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))
    offsets = pa.array([None if k < len(rows) and rows[k] is None else e for k, e in enumerate(ends)], pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


_SEGMENT_FIELDS = {"type": pa.string(), "text": pa.string()}
_HEAT_FIELDS = {"text": pa.string(), "score": pa.float64(), "kept": pa.bool_()}


def _pairs(before: pa.Array, after: pa.Array) -> Iterator[list[tuple[str | None, str | None]]]:
    for at in range(0, len(before), _ROWS):
        yield list(zip(before.slice(at, _ROWS).to_pylist(), after.slice(at, _ROWS).to_pylist()))


def _diff(a: str | None, b: str | None) -> list[tuple[str, str]] | None:
    return None if a is None or b is None else compare.diff(a, b)


def word_diff(before: Column | str, after: Column | str) -> Column:
    """Segments; null where the texts are too large for each other."""

    @F.arrow_udf(_SEGMENTS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            for rows in _pairs(x, y):
                yield _lists([_diff(a, b) for a, b in rows], _SEGMENT_FIELDS)

    return run(before, after)


def compared(before: Column | str, after: Column | str, mode: str = "ultra") -> Column:
    """The diff of two texts and the first one's heat map from it, as (diff, heat)."""

    @F.arrow_udf(_struct(diff=_SEGMENTS, heat=_HEAT))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            for rows in _pairs(x, y):
                diffs = [_diff(a, b) for a, b in rows]
                heat = [None if a is None or b is None else compare.heat_of(a, d, mode) for (a, b), d in zip(rows, diffs)]
                yield pa.StructArray.from_arrays([_lists(diffs, _SEGMENT_FIELDS), _lists(heat, _HEAT_FIELDS)], names=["diff", "heat"])

    return run(before, after)


def heatmap(before: Column | str, after: Column | str, mode: str = "ultra") -> Column:
    return compared(before, after, mode)["heat"]


@F.pandas_udf(T.ArrayType(_struct(kind=_TEXT, preview=_TEXT)))
def preserved_blocks(s: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else [{"kind": k, "preview": p} for k, p in compare.preserved(t)] for t in s], dtype=object)


_COUNTS = ("arrays", "json_bytes", "json_tokens", "gcf_bytes", "gcf_tokens", "toon_bytes", "toon_tokens")
_ENCODED = _struct(**dict.fromkeys(_COUNTS, _LONG), winner=_TEXT)


@F.pandas_udf(_ENCODED)
def encodings(s: pd.Series) -> pd.DataFrame:
    rows = [compare.encodings(t or "") for t in s]
    return pd.DataFrame(rows, columns=[*_COUNTS, "winner"]).astype(dict.fromkeys(_COUNTS, "Int64"))
