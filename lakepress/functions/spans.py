"""Gates: high-entropy and risk spans that operators must not touch, and facts that must survive.

Plain functions on one text each; udfs.py runs them over Arrow batches.
"""

from __future__ import annotations

import re

_A = re.ASCII
_SPACES = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S, _NOT_S = f"[{_SPACES}]", f"[^{_SPACES}]"

# Categories and patterns in order of evaluation.
QUANTUM = [
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,512}(?![A-Za-z0-9_-])", _A)),
    ("api_key", re.compile(r"\b(?:sk|pk|rk|ghp|gho|xox[baprs])[-_][A-Za-z0-9]{16,200}\b", _A)),
    ("api_key", re.compile(r"\bBearer[ \t]{1,4}[A-Za-z0-9._-]{16,400}\b", _A)),
    ("uuid", re.compile(r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", _A)),
    ("request_id", re.compile(r"\b(?:req|trace|span|corr|request)[-_:][A-Za-z0-9]{6,128}\b", _A)),
    ("long_hex", re.compile(r"\b[0-9a-f]{16,128}\b", _A)),
    ("unix_ts", re.compile(r"\b1[0-9]{9}(?:[0-9]{3})?\b", _A)),
]
RISK_SPANS = [
    ("stack_trace", 2, re.compile(rf"^{_S}+at{_S}+.+:[0-9]+", re.M)),
    ("private_key", 1, re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)),
    ("secret_assignment", 2, re.compile(rf"^[A-Za-z0-9_.-]*(?:secret|password|token|api[_-]?key)[A-Za-z0-9_]*{_S}*[:=]{_S}*{_NOT_S}+$", re.M | re.I)),
]
DOCUMENT_RISKS = [
    ("k8s_secret", lambda t: bool(re.search(rf"kind:{_S}*Secret\b", t, _A) and re.search(r"\bdata:", t, _A))),
    ("db_migration", lambda t: len(re.findall(r"CREATE TABLE|ALTER TABLE|ADD COLUMN|DROP (?:TABLE|COLUMN)", t, re.I)) >= 2),
    ("legal", lambda t: len(re.findall(r"CONFIDENTIAL|PRIVILEGED AND PROPRIETARY", t)) >= 2),
]
NEEDLES = [
    ("url", re.compile(rf"\bhttps?://{_NOT_S}+", _A)),
    ("version", re.compile(r"\b\d+(?:\.\d+){1,3}\b", _A)),
    ("dotted_identifier", re.compile(r"\b[A-Za-z_][\w$]*(?:\.[\w$]+)+\b", _A)),
    ("function_call", re.compile(r"\b[A-Za-z_]\w*\([^()]*\)", _A)),
    ("file_path", re.compile(r"\b[\w-]+(?:/[\w.-]+)+\b", _A)),
    ("inline_code", re.compile(r"`[^`\n]+`")),
    ("const_case", re.compile(r"\b[A-Z][A-Z0-9_]{2,}\b", _A)),
]
#: What a kind of needle can't do without.
_SIGNS = {"url": "://", "version": ".", "dotted_identifier": ".", "function_call": "(", "file_path": "/", "inline_code": "`"}
NUMBER = re.compile(r"\d[\d.,]{0,40}", _A)
JSON_KEY = re.compile(rf'"([A-Za-z_$][A-Za-z0-9_$-]{{0,80}})"{_S}*:')
HUNK = re.compile(r"@@ -\d{1,9}(?:,\d{1,9})? \+\d{1,9}(?:,\d{1,9})? @@", _A)
CRITICAL_PERCENT, JSON_KEY_PERCENT, MIN_NOVEL_CHARS = 95, 90, 8
_LEVELS = r"(?:debug|trace|verbose|info|warn(?:ing)?|error|fatal|notice)"
LOG_LINES = [
    re.compile(rf"{_S}*\[?\d{{4}}-\d{{2}}-\d{{2}}[T ][\d:.]+", _A),
    re.compile(rf"{_S}*[\[(]?{_LEVELS}\b[\]):]?{_S}", re.I | _A),
    re.compile(rf"{_S}*\w[\w./+-]*{_S}+{_LEVELS}\b[\]):]?{_S}", re.I | _A),
    re.compile(rf"{_S}*(?:warning|error|note|help)(?:\[[A-Z\d]+\])?{_S}*:", re.I | _A),
    re.compile(rf"{_S}*-->{_S}"),
    re.compile(rf"{_S}*\|"),
    re.compile(rf"{_S}*={_S}(?:note|help){_S}*:"),
    re.compile(rf"{_S}*\[\d+(?:/\d+)?\]{_S}", _A),
    re.compile(rf"{_S}*(?:Compiling|Building|Linking|Packing|Running){_S}"),
]
_NUMBERED = re.compile(rf"{_S}*\d+\t", _A)
#: What ECMAScript takes for white space.
WHITE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def is_log_line(line: str) -> bool:
    m = _NUMBERED.match(line)
    bare = line[m.end() :] if m else line
    return any(p.match(bare) for p in LOG_LINES)


_DIGITS, _BLANKS = re.compile(r"[0-9]+"), re.compile(f"{_S}+")


def normalize_line(line: str) -> str:
    if line.isascii() and line.isprintable():  # no other white space than blanks
        return _DIGITS.sub("#", " ".join(line.lower().split()))
    return _BLANKS.sub(" ", _DIGITS.sub("#", line.strip(WHITE).lower()))


def lock(text: str) -> tuple[str, list[str], dict[str, int]]:
    """The text with numbered places for high-entropy spans, the spans, and how many of each category."""
    values: list[str] = []
    counts: dict[str, int] = {}
    for category, pattern in QUANTUM:

        def put(m: re.Match, category: str = category) -> str:
            values.append(m[0])
            counts[category] = counts.get(category, 0) + 1
            return f"⟦Q{len(values) - 1}⟧"

        text = pattern.sub(put, text)
    return text, values, counts


def unlock(text: str, values: list[str]) -> str:
    """Spans in their places, last ones first, as they may hold earlier ones."""
    for k in range(len(values) - 1, -1, -1):
        text = text.replace(f"⟦Q{k}⟧", values[k])
    return text


def document_risk(text: str) -> str | None:
    """The category for which a whole document is left alone; the first that fits."""
    return next((name for name, fits in DOCUMENT_RISKS if fits(text)), None)


def mask(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with numbered places for risk spans, and (category, span); a category counts from its least number on."""
    values: list[tuple[str, str]] = []
    for category, least, pattern in RISK_SPANS:
        if len(pattern.findall(text)) < least:
            continue

        def put(m: re.Match, category: str = category) -> str:
            values.append((category, m[0]))
            return f"⟦risk_{category}{len(values) - 1}⟧"

        text = pattern.sub(put, text)
    return text, values


def unmask(text: str, values: list[tuple[str, str]]) -> str:
    for k in range(len(values) - 1, -1, -1):
        text = text.replace(f"⟦risk_{values[k][0]}{k}⟧", values[k][1])
    return text


def facts(text: str) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """Needles (kind, text), numbers and hunk heads, in order of first sight; log lines and repeated lines have none."""
    seen: set[str] = set()
    needles: dict[tuple[str, str], None] = {}
    numbers: dict[str, None] = {}
    hunks: dict[str, None] = {}
    for line in text.split("\n"):
        normal = normalize_line(line)
        long = len(normal) >= MIN_NOVEL_CHARS or len(normal.encode("utf-16-le", "surrogatepass")) >= 2 * MIN_NOVEL_CHARS
        repeat = long and normal in seen
        if long:
            seen.add(normal)
        if repeat or is_log_line(line):
            continue
        for kind, pattern in NEEDLES:
            if _SIGNS.get(kind, "") in line:
                needles.update(((kind, x), None) for x in pattern.findall(line))
        numbers.update((x, None) for x in NUMBER.findall(line))
        if "@@" in line:
            hunks.update((x, None) for x in HUNK.findall(line))
    return list(needles), list(numbers), list(hunks)


def infidelity(before: str, after: str) -> str | None:
    """Why `after` does not keep what `before` says, or None."""
    if before == after:
        return None
    needles, numbers, hunks = facts(before)
    lost = [kind for kind, x in needles if x not in after]
    if needles and (len(needles) - len(lost)) / len(needles) * 100 < CRITICAL_PERCENT:
        return f"fidelity:critical({lost[0]}:{len(needles) - len(lost)}/{len(needles)})"
    keys = list(dict.fromkeys(JSON_KEY.findall(before)))
    kept = sum(f'"{k}"' in after for k in keys)
    if keys and kept / len(keys) * 100 < JSON_KEY_PERCENT:
        return f"fidelity:json-keys({kept}/{len(keys)})"
    gone = next((x for x in numbers if x not in after), None)
    if gone is not None:
        return f"fidelity:numeric({gone})"
    return "fidelity:hunk" if any(x not in after for x in hunks) else None
