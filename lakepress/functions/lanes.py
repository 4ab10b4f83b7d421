"""The cascade on one text: engines in turn, gates around them, as one pass over an Arrow batch.

The engines that built-in expressions can say also exist as columns (logs.py); tests hold
the two forms against each other. A cascade runs here because each lane needs the last
lane's text, and one trip over a batch costs less than one for each lane and gate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lakepress.functions import compare, prose, spans

_S = spans._S
_SEVERITY = re.compile("ERROR|WARN|Error:|Exception:")
_STAMP = re.compile(rf"{_S}*\[?\d{{4}}-\d{{2}}-\d{{2}}[T ][\d:.]+(?:Z|[+-]\d{{2}}:?\d{{2}})?\]?{_S}*\Z", re.ASCII)
_DEBUG = re.compile(rf"{_S}*\[?(?:debug|trace|verbose)\]?:?{_S}*\Z", re.I | re.ASCII)
_BANNER = re.compile(rf"(?:{_S}|[=*#~_-]){{4,}}\Z")
_PROMPT = re.compile(rf"(?:\A|\n){_S}*\${_S}")
_ERRORS = re.compile(r"Error:|Exception:|Traceback \(most recent call last\):")


def tokens(text: str) -> int:
    return -(-len(text.encode()) // 4)


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def truncate(text: str) -> tuple[str, int]:
    """First lines of each identity and severity lines stay; runs of others become markers."""
    rows = text.split("\n")
    if len(rows) <= 120 and units(text) <= 12_000:
        return text, 0
    seen: set[str] = set()
    out: list[str] = []
    run = lost = 0
    for row in [*rows, None]:
        keep = row is None
        if row is not None:
            own = spans.normalize_line(row)
            novel = units(own) >= spans.MIN_NOVEL_CHARS and own not in seen
            if novel:
                seen.add(own)
            keep = novel or bool(_SEVERITY.search(row))
        if not keep:
            run, lost = run + 1, lost + 1
            continue
        if run:
            out.append(f"[… {run} lines truncated …]")
            run = 0
        if row is not None:
            out.append(row)
    return "\n".join(out), lost


def collapse_runs(text: str) -> str:
    out: list[str] = []
    rows = text.split("\n")
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end] == rows[at]:
            end += 1
        out += [f"{rows[at]} (×{end - at})"] if end - at >= 3 else rows[at:end]
        at = end
    return "\n".join(out)


def filter_lines(text: str) -> str:
    left = [x for x in text.split("\n") if not _STAMP.match(x) and not _DEBUG.match(x)]
    return "\n".join(x for k, x in enumerate(left) if not (k and x == left[k - 1] and _BANNER.match(x)))


def log_shaped(text: str) -> bool:
    full = [x for x in text.split("\n") if x.strip(spans.WHITE)]
    return len(full) >= 8 and sum(map(spans.is_log_line, full)) / len(full) >= 0.6


def _rtk(text: str, shell: bool) -> tuple[str, str | None, list[str], list[str]]:
    aware = shell or bool(_PROMPT.search(text)) or log_shaped(text)
    if not aware and not _ERRORS.search(text):
        return text, "document", [], []
    notes, now = [], text
    for name, change in (("rtk-filter", filter_lines if aware else None), ("rtk-dedup", collapse_runs), ("rtk-code-strip", compare.strip_comments)):
        new = change(now) if change else now
        if new != now:
            notes.append(name)
        now = new
    now, lost = truncate(now)
    return now, None, notes + ["rtk-truncate"] * bool(lost), []


#: Output, skip reason, techniques, rules.
Applied = tuple[str, "str | None", list[str], list[str]]
#: (text, whether a shell tool wrote it, intensity, fuzzy) -> Applied
Engine = Callable[[str, bool, str, bool], Applied]
#: Why a step must be taken back, from the texts before and after it; None where it may stand.
Check = Callable[[str, str], "str | None"]


def _dedup(text: str, shell: bool, intensity: str, fuzzy: bool) -> Applied:
    out, removed = compare.drop_similar_blocks(text, fuzzy)
    return out, None, ["session-dedup"] * bool(removed), []


def _truncate(text: str, shell: bool, intensity: str, fuzzy: bool) -> Applied:
    out, _ = truncate(text)
    return out, None, ["rtk-truncate"] * (out != text), []


def _prose(text: str, shell: bool, intensity: str, fuzzy: bool) -> Applied:
    done = prose.condense(text, intensity)
    return done.output, done.skipped, done.techniques, done.rules


#: The registry that cascades read; more engines may be added.
ENGINES: dict[str, Engine] = {
    "dedup": _dedup,
    "rtk": lambda text, shell, intensity, fuzzy: _rtk(text, shell),
    "truncate": _truncate,
    "caveman": _prose,
    "lite": lambda text, shell, intensity, fuzzy: _prose(text, shell, "lite", fuzzy),
}


def known(names: list[str]) -> list[str]:
    """The names, all of which must be in the registry."""
    for name in names:
        if name not in ENGINES:
            raise ValueError(f"no engine is called {name!r}; there are {', '.join(ENGINES)}")
    return names


def step(engine: str, text: str, shell: bool = False, intensity: str = "full", fuzzy: bool = True, check: bool | Check = False, count: Callable[[str], int] = tokens) -> dict:
    """One engine with its accounting: no output without fewer tokens, nor one that `check` (True: lost facts) objects to."""
    known([engine])
    out, skipped, techniques, rules = ENGINES[engine](text, shell, intensity, fuzzy)
    before, after = count(text), count(out)
    why = skipped or ("no-gain" if after >= before else None)
    if not why and check:
        why = (spans.infidelity if check is True else check)(text, out)
    return {
        "engine": engine,
        "input": text,
        "output": text if why else out,
        "original_tokens": before,
        "compressed_tokens": before if why else after,
        "savings_percent": 0.0 if why else int((before - after) / before * 1000 + 0.5) / 10,
        "techniques": techniques,
        "rules": [] if out == text else rules,
        "rejected": bool(why),
        "reject_reason": why,
    }


def cascade(text: str, lanes: list[str], shell: bool = False, intensity: str = "full", fuzzy: bool = True, check: bool | Check = False, count: Callable[[str], int] = tokens) -> tuple[str, list[dict]]:
    steps = []
    for lane in lanes:
        steps.append(step(lane, text, shell, intensity, fuzzy, check, count))
        text = steps[-1]["output"]
    return text, steps


@dataclass(frozen=True)
class Gated:
    output: str
    steps: list[dict]
    reason: str | None


def gated(text: str, lanes: list[str], shell: bool, intensity: str, fidelity: bool, risk: bool, quantum: bool, fuzzy: bool, count: Callable[[str], int] = tokens) -> Gated:
    """The cascade between the gates; the text stays unless every place came through once and the result is smaller."""
    why = spans.document_risk(text) if risk else None
    if why:
        return Gated(text, [], f"risk:{why}")
    masked, risky = spans.mask(text) if risk else (text, [])
    locked, values, _ = spans.lock(masked) if quantum else (masked, [], {})
    out, steps = cascade(locked, lanes, shell, intensity, fuzzy, fidelity, count)
    places = [f"⟦Q{k}⟧" for k in range(len(values))] + [f"⟦risk_{c}{k}⟧" for k, (c, _) in enumerate(risky)]
    if any(out.count(p) != locked.count(p) for p in places):
        return Gated(text, steps, "placeholder-lost")
    back = spans.unmask(spans.unlock(out, values), risky)
    if re.search(r"⟦(?:Q\d+|risk_[a-z_]+\d+)⟧", back, re.ASCII) and not re.search(r"⟦(?:Q\d+|risk_[a-z_]+\d+)⟧", text, re.ASCII):
        return Gated(text, steps, "placeholder-lost")
    if not (units(back) < units(text) and count(back) < count(text)):
        return Gated(text, steps, "no-gain")
    return Gated(back, steps, None)
