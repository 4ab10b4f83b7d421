"""Line operators inside a row: log shape, filters, runs, first occurrences, truncation.

Every function works on arrays of lines by higher-order functions, so a document
never leaves its row and nothing is exchanged. First occurrences come from sorting
(line, place) pairs and comparing neighbours, so the cost is n log n in the lines.
Functions that need an intermediate array several times add it as a column first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.functions.text import LEFT, RIGHT, WS, lines, normalize_line, trim, truncated_marker, utf16_length

#: Fixed values.
MAX_LINES, MAX_CHARS, MIN_NOVEL_CHARS = 120, 12_000, 8
MIN_LOG_LINES, MIN_LOG_RATIO = 8, 0.6
SEVERITY = "ERROR|WARN|Error:|Exception:"
_LEVELS = "debug|trace|verbose|info|warn(?:ing)?|error|fatal|notice"
LOG_SHAPES = (
    f"\\A{WS}*\\[?[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.]+",
    f"(?i)\\A{WS}*[\\[(]?(?:{_LEVELS}){RIGHT}[\\]):]?{WS}",
    f"(?i)\\A{WS}*[A-Za-z0-9_][A-Za-z0-9_./+-]*{WS}+(?:{_LEVELS}){RIGHT}[\\]):]?{WS}",
    f"(?i)\\A{WS}*(?:warning|error|note|help)(?:\\[[A-Z0-9]+\\])?{WS}*:",
    f"\\A{WS}*-->{WS}",
    f"\\A{WS}*\\|",
    f"\\A{WS}*={WS}(?:note|help){WS}*:",
    f"\\A{WS}*\\[[0-9]+(?:/[0-9]+)?\\]{WS}",
    f"\\A{WS}*(?:Compiling|Building|Linking|Packing|Running){WS}",
)
STAMP_ONLY = f"\\A{WS}*\\[?[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.]+(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?\\]?{WS}*\\z"
EMPTY_DEBUG = f"(?i)\\A{WS}*\\[?(?:debug|trace|verbose)\\]?:?{WS}*\\z"
DECORATIVE = f"\\A(?:{WS}|[=*#~_-]){{4,}}\\z"
CODE_LINE = f"[{{}};=]{WS}*\\z|\\A{WS}{{4,}}[^\\s\\u00A0\\uFEFF]|=>|\\A{WS}*(?:function|const|let|var|class|import|export|def|return){RIGHT}"
ERRORS = "Error:|Exception:|Traceback \\(most recent call last\\):"
PROMPT = f"(?:\\A|\\n){WS}*\\${WS}"


def is_log_line(line: Column) -> Column:
    bare = F.regexp_replace(line, f"\\A{WS}*[0-9]+\\t", "")
    out = F.lit(False)
    for shape in LOG_SHAPES:
        out = out | bare.rlike(shape)
    return out


def is_log_shaped(text: Column) -> Column:
    """At least 8 lines that are not blank, 60 % of them like log lines."""
    full = F.filter(lines(text), lambda x: trim(x) != "")
    logs = F.size(F.filter(full, is_log_line))
    return (F.size(full) >= MIN_LOG_LINES) & (logs / F.size(full) >= MIN_LOG_RATIO)


def is_command_aware(text: Column, shell: Column) -> Column:
    return F.coalesce(shell, F.lit(False)) | text.rlike(PROMPT) | is_log_shaped(text)


def has_error(text: Column) -> Column:
    return text.rlike(ERRORS)


def is_code_dominant(text: Column) -> Column:
    """At least 3 lines that are not blank, 30 % of them like code."""
    full = F.filter(lines(text), lambda x: trim(x) != "")
    return (F.size(full) >= 3) & (F.size(F.filter(full, lambda x: x.rlike(CODE_LINE))) / F.size(full) >= 0.3)


def has_protected_structure(text: Column) -> Column:
    """URLs, links, table rows, versions, environment references or calls without arguments, in text with special characters."""
    structure = f"(?m)https?://|\\[[^\\]]+\\]\\([^)]*\\)|^{WS}*\\|.+\\|{WS}*$|{LEFT}[0-9]+(?:\\.[0-9]+){{1,3}}{RIGHT}|process\\.env\\.[A-Za-z_$][A-Za-z0-9_$]*|{LEFT}[A-Za-z_][A-Za-z0-9_]*\\({WS}*\\)"
    return text.rlike("[`~\\[\\]$#\\\\/:_()0-9]") & text.rlike(structure)


def _shifted(items: Column) -> Column:
    """The item before each item; null before the first."""
    return F.slice(F.concat(F.array(F.get(items, F.lit(-1))), items), F.lit(1), F.size(items))


def with_runs(df: DataFrame, items: str, out: str) -> DataFrame:
    """Runs of equal neighbours: array<struct<k, v>> becomes array<struct<k, v, n>>."""
    at, starts = f"__{out}_at", f"__{out}_starts"
    df = df.withColumn(at, F.transform(items, lambda x, i: F.struct(i.alias("i"), x["k"].alias("k"), x["v"].alias("v"))))
    both = F.zip_with(at, _shifted(F.col(at)), lambda a, b: F.struct(a["i"].alias("i"), a["k"].alias("k"), a["v"].alias("v"), (b.isNull() | (a["k"] != b["k"])).alias("new")))
    df = df.withColumn(starts, F.filter(both, lambda x: x["new"]))
    ends = F.concat(F.transform(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda x: x["i"]), F.array(F.size(at)))
    return df.withColumn(out, F.zip_with(starts, ends, lambda a, e: F.struct(a["k"].alias("k"), a["v"].alias("v"), (e - a["i"]).alias("n")))).drop(at, starts)


def with_first_seen(df: DataFrame, of: Column, out: str) -> DataFrame:
    """For each line of array `of`: whether it is the first with its identity (and long enough to count), and whether it repeats one."""
    pairs = f"__{out}_pairs"
    df = df.withColumn(pairs, F.array_sort(F.transform(of, lambda x, i: F.struct(normalize_line(x).alias("n"), i.alias("i")))))
    flags = F.zip_with(
        pairs,
        _shifted(F.col(pairs)),
        lambda a, b: F.struct(a["i"].alias("i"), ((utf16_length(a["n"]) >= MIN_NOVEL_CHARS) & (b.isNull() | (a["n"] != b["n"]))).alias("novel"), ((utf16_length(a["n"]) >= MIN_NOVEL_CHARS) & b.isNotNull() & (a["n"] == b["n"])).alias("repeat")),
    )
    return df.withColumn(out, F.array_sort(flags)).drop(pairs)


def with_truncated(df: DataFrame, text: str, out: str, dropped: str, always: bool = False) -> DataFrame:
    """Semantics-first truncation of texts over 120 lines or 12,000 characters.

    Kept are the first line of each identity of 8 characters or more and every line with a
    severity; each run of others becomes a marker with its length.
    """
    ln, seen, keyed, runs = f"__{out}_lines", f"__{out}_seen", f"__{out}_keyed", f"__{out}_runs"
    over = F.lit(True) if always else (F.size(lines(F.col(text))) > MAX_LINES) | (utf16_length(F.col(text)) > MAX_CHARS)
    df = df.withColumn(ln, F.when(over, lines(F.col(text))))
    df = with_first_seen(df, F.col(ln), seen)
    keep = F.zip_with(ln, seen, lambda x, s: F.struct(F.when(s["novel"] | x.rlike(SEVERITY), s["i"]).otherwise(-1).alias("k"), x.alias("v")))
    df = with_runs(df.withColumn(keyed, keep), keyed, runs)
    joined = F.array_join(F.transform(runs, lambda r: F.when(r["k"] >= 0, r["v"]).otherwise(truncated_marker(r["n"]))), "\n")
    lost = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.when(r["k"] < 0, r["n"]).otherwise(0))
    return df.withColumns({out: F.when(F.col(ln).isNotNull(), joined).otherwise(F.col(text)), dropped: F.when(F.col(ln).isNotNull(), lost).otherwise(F.lit(0).cast("long"))}).drop(ln, seen, keyed, runs)


def with_collapsed_runs(df: DataFrame, text: str, out: str) -> DataFrame:
    """Three or more equal neighbouring lines become one with a count."""
    keyed, runs = f"__{out}_keyed", f"__{out}_runs"
    df = df.withColumn(keyed, F.transform(lines(F.col(text)), lambda x: F.struct(x.alias("k"), x.alias("v"))))
    df = with_runs(df, keyed, runs)
    parts = F.transform(runs, lambda r: F.when(r["n"] >= 3, F.array(F.concat(r["v"], F.lit(" (×"), r["n"].cast("string"), F.lit(")")))).otherwise(F.array_repeat(r["v"], r["n"])))
    return df.withColumn(out, F.array_join(F.flatten(parts), "\n")).drop(keyed, runs)


def with_filtered_lines(df: DataFrame, text: str, out: str) -> DataFrame:
    """Without lines that are only a time stamp or an empty debug mark, and without repeated decorative lines."""
    left = f"__{out}_left"
    df = df.withColumn(left, F.filter(lines(F.col(text)), lambda x: ~(x.rlike(STAMP_ONLY) | x.rlike(EMPTY_DEBUG))))
    kept = F.filter(F.zip_with(left, _shifted(F.col(left)), lambda a, b: F.struct(a.alias("v"), (b.isNotNull() & (a == b) & a.rlike(DECORATIVE)).alias("again"))), lambda x: ~x["again"])
    return df.withColumn(out, F.array_join(F.transform(kept, lambda x: x["v"]), "\n")).drop(left)


def with_deduplicated_blocks(df: DataFrame, text: str, out: str, removed: str) -> DataFrame:
    """Later copies of paragraphs of at least 80 normalised characters go, with a worded marker at the end (exact form)."""
    from lakepress.functions.text import elided_marker, normalize_block

    blocks, pairs, flags = f"__{out}_blocks", f"__{out}_pairs", f"__{out}_flags"
    df = df.withColumn(blocks, F.split(text, "\n\n", -1))
    df = df.withColumn(pairs, F.array_sort(F.transform(blocks, lambda x, i: F.struct(normalize_block(x).alias("n"), i.alias("i")))))
    again = F.zip_with(pairs, _shifted(F.col(pairs)), lambda a, b: F.struct(a["i"].alias("i"), (b.isNotNull() & (a["n"] == b["n"]) & (utf16_length(a["n"]) >= 80)).alias("again")))
    df = df.withColumn(flags, F.array_sort(again))
    kept = F.transform(F.filter(F.zip_with(blocks, flags, lambda x, f: F.struct(x.alias("v"), f["again"].alias("again"))), lambda x: ~x["again"]), lambda x: x["v"])
    n = F.size(F.filter(flags, lambda f: f["again"])).cast("long")
    df = df.withColumn(removed, n)
    return df.withColumn(out, F.when(F.col(removed) == 0, F.col(text)).otherwise(F.concat(F.array_join(kept, "\n\n"), F.lit("\n\n"), elided_marker(F.col(removed))))).drop(blocks, pairs, flags)
