"""Column expressions for text: white space, identities, sizes, tokens, markers.

Boundaries and word characters are ASCII, and white space is the set that
ECMAScript's \\s has, so results do not hang on a regular-expression dialect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class for Java's regular expressions.
WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: ASCII word boundaries.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: Fixed values.
COUNT_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
SHELL_TOOLS = ("bash", "shell", "terminal", "run_command", "execute_command", "exec", "command")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A{WS}+|{WS}+\\z", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(c, f"{WS}+", " ")


def normalize_block(c: Column) -> Column:
    return trim(collapse(F.lower(c)))


def normalize_line(c: Column) -> Column:
    """Lines that differ in digits, case or blanks only are the same."""
    return collapse(F.regexp_replace(F.lower(trim(c)), "[0-9]+", "#"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(c) + F.regexp_count(c, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def token_count(c: Column) -> Column:
    """A token for every four bytes of UTF-8; any column expression may stand in for it."""
    return F.ceil(F.octet_length(c) / F.lit(4.0)).cast("long")


def savings_percent(before: Column, after: Column) -> Column:
    """Rounded half up to one decimal; 0 where nothing was there."""
    return F.when(before > 0, F.floor((before - after) / before * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)).otherwise(F.lit(0.0))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 24)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def is_shell_tool(name: Column) -> Column:
    return F.coalesce(name.rlike(f"{LEFT}(?:{'|'.join(SHELL_TOOLS)}){RIGHT}"), F.lit(False))


def truncated_marker(n: Column) -> Column:
    return F.concat(F.lit("[… "), n.cast("string"), F.lit(" lines truncated …]"))


def elided_marker(n: Column) -> Column:
    """Counts up to nine in words; digits could pass for numbers of the text."""
    words = F.array(*[F.lit(w + " ") for w in COUNT_WORDS])
    word = F.when(n <= len(COUNT_WORDS), F.get(words, n.cast("int") - 1)).otherwise(F.lit(""))
    return F.concat(F.lit("[… "), word, F.lit("duplicate block"), F.when(n == 1, "").otherwise("s"), F.lit(" elided …]"))


def reference_marker(sha: Column, n_lines: Column, chars: Column) -> Column:
    return F.concat(F.lit("[dedup:ref sha="), sha, F.lit("] identical to an earlier block above (~"), n_lines.cast("string"), F.lit(" lines, "), chars.cast("string"), F.lit(" chars omitted)"))


def cleared_marker(tokens: Column) -> Column:
    return F.concat(F.lit("[cleared: tool result elided to free context — ~"), tokens.cast("string"), F.lit(" tok removed]"))


def format_count(n: Column) -> Column:
    """980, 12.3k, 3.4M."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k"))).otherwise(n.cast("string"))


def format_bytes(n: Column) -> Column:
    """812 B, 12.3 kB, 3.4 MB."""
    return F.when(n >= 1_048_576, F.concat(F.format_string("%.1f", n / 1_048_576.0), F.lit(" MB"))).when(n >= 1_024, F.concat(F.format_string("%.1f", n / 1_024.0), F.lit(" kB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_savings(percent: Column) -> Column:
    return F.concat(F.lit("−"), F.format_string("%.1f", percent), F.lit("%"))


def bar(fraction: Column, width: int) -> Column:
    filled = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("▓"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def step_label(engine: Column, percent: Column) -> Column:
    return F.concat(F.rpad(engine, 9, " "), F.lit(" "), format_savings(percent))


def language_route(c: Column) -> Column:
    """ru where ten times the Cyrillic letters are at least three times the Latin ones, else en."""
    return F.when(F.regexp_count(c, F.lit("\\p{IsCyrillic}")) * 10 >= F.regexp_count(c, F.lit("[A-Za-z]")) * 3, "ru").otherwise("en")


def verdict(reply: Column) -> Column:
    """same, materially-differs or unparseable, by the last line that is not blank; an explicit verdict goes first."""
    full = F.filter(lines(F.lower(trim(reply))), lambda x: trim(x) != "")
    last = F.coalesce(F.get(full, F.size(full) - 1), F.lit(""))
    differs = f"materially(?:{WS}|[_-])*differs"
    explicit = F.regexp_extract(last, f"verdict:{WS}*(same|{differs})", 1)
    return F.when(explicit == "same", "same").when(explicit != "", "materially-differs").when(last.rlike(differs), "materially-differs").when(last.rlike(f"{LEFT}same{RIGHT}"), "same").otherwise("unparseable")


def force_preserve(token: Column) -> Column:
    """Tokens that a heat map always scores 1: URLs, paths, versions, dotted names, code, long numbers."""
    return token.rlike(
        f"{LEFT}https?://|\\A\\.{{0,2}}/|{LEFT}[0-9]+(?:\\.[0-9]+){{1,3}}{RIGHT}|{LEFT}[A-Za-z_][A-Za-z0-9_$]*(?:\\.[A-Za-z0-9_$]+)+(?:{RIGHT}(?<=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))|\\A`[^\\n\\r\\u2028\\u2029]*`\\z|\\A[0-9]{{3,}}\\z"
    )


def recalled(answer: Column, needle: Column) -> Column:
    """Whether an answer has a needle: as it is, with white space collapsed, or (without blanks) over line breaks."""
    joined = F.regexp_replace(answer, f"{WS}*\\n{WS}*", "")
    return F.contains(answer, needle) | F.contains(collapse(answer), collapse(needle)) | (~F.contains(needle, F.lit(" ")) & F.contains(joined, needle))
