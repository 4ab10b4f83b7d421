"""Settings: presets, validation, atomic files. Driver-side only."""

from __future__ import annotations

import json
import math
import os
import tempfile
import threading
from dataclasses import asdict, dataclass, field, replace

LANES = ("dedup", "rtk", "truncate", "caveman")


@dataclass(frozen=True)
class Engines:
    dedup: bool = False
    rtk: bool = False
    truncate: bool = True
    caveman: bool = False
    session_dedup: bool = True
    clear: bool = False


@dataclass(frozen=True)
class Gates:
    fidelity: bool = True
    risk: bool = True
    quantum: bool = True
    fuzzy_dedup: bool = True


@dataclass(frozen=True)
class Config:
    enabled: bool = False
    strategy: str = "interactive"
    engines: Engines = field(default_factory=Engines)
    intensity: str = "full"
    preserve_system_prompt: bool = True
    gates: Gates = field(default_factory=Gates)
    heatmap: str = "ultra"
    judge_model: str = ""
    cost_cap_usd: float = 0.1
    debug: bool = False
    clear_trigger_tokens: int = 100_000
    clear_keep: int = 3

    @property
    def tool_lanes(self) -> tuple[str, ...]:
        return tuple(x for x in LANES if getattr(self.engines, x))

    @property
    def user_lanes(self) -> tuple[str, ...]:
        return ("caveman",) if self.engines.caveman else ()


def _engines(marks: str) -> Engines:
    names = ("dedup", "rtk", "truncate", "caveman", "session_dedup", "clear")
    return Engines(**{n: m == "x" for n, m in zip(names, marks)})


#: Dedup, rtk, truncate, caveman, session dedup, clear; and the intensity.
PRESETS: dict[str, tuple[Engines, str]] = {
    "off": (_engines("------"), "full"),
    "interactive": (_engines("--x-x-"), "full"),
    "lite": (_engines("---x--"), "lite"),
    "standard": (_engines("---x--"), "full"),
    "aggressive": (_engines("-x-x--"), "full"),
    "ultra": (_engines("xxxxxx"), "ultra"),
    "rtk": (_engines("-x----"), "full"),
    "stacked": (_engines("xxxxx-"), "full"),
    "omniroute": (_engines("--x-x-"), "lite"),
}


def with_preset(config: Config, strategy: str) -> Config:
    """The preset's engines and intensity; `off` also disables."""
    engines, intensity = PRESETS[strategy]
    return replace(config, strategy=strategy, engines=engines, intensity=intensity, enabled=config.enabled and strategy != "off")


def _number(value: object, default: float) -> float:
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return value if ok else default  # type: ignore[return-value]


def sanitize(raw: object) -> Config:
    """A valid configuration from anything: bad or missing fields take defaults, numbers are clamped."""
    src = raw if isinstance(raw, dict) else {}
    base = Config()

    def flags(kind: type, name: str):
        own = src.get(name) if isinstance(src.get(name), dict) else {}
        return kind(**{k: own[k] if isinstance(own.get(k), bool) else v for k, v in asdict(getattr(base, name)).items()})

    def flag(name: str) -> bool:
        return src[name] if isinstance(src.get(name), bool) else getattr(base, name)

    def one_of(name: str, allowed) -> str:
        return src[name] if isinstance(src.get(name), str) and src[name] in allowed else getattr(base, name)

    return Config(
        enabled=flag("enabled"),
        strategy=one_of("strategy", PRESETS),
        engines=flags(Engines, "engines"),
        intensity=one_of("intensity", ("lite", "full", "ultra")),
        preserve_system_prompt=flag("preserve_system_prompt"),
        gates=flags(Gates, "gates"),
        heatmap=one_of("heatmap", ("ultra", "universal")),
        judge_model=src["judge_model"] if isinstance(src.get("judge_model"), str) else base.judge_model,
        cost_cap_usd=min(5.0, max(0.01, _number(src.get("cost_cap_usd"), base.cost_cap_usd))),
        debug=flag("debug"),
        clear_trigger_tokens=int(min(2_000_000, max(10_000, _number(src.get("clear_trigger_tokens"), base.clear_trigger_tokens)))),
        clear_keep=int(min(20, max(1, math.floor(_number(src.get("clear_keep"), base.clear_keep) + 0.5)))),
    )


def load(path: str) -> Config:
    """From a file; a missing or corrupt one gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return sanitize(json.load(f))
    except (OSError, ValueError):
        return Config()


_lock = threading.Lock()


def save(config: Config, path: str) -> None:
    """Write beside the file and rename, one writer at a time."""
    with _lock:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(asdict(config), f, indent=2)
        os.replace(name, path)
