"""What a studio shows: dry runs of all lanes, recent runs, and the commands that switch compression."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.functions import udfs
from lakepress.functions.text import trim, utf16_length
from lakepress.operators import measure, steps
from lakepress.plans.config import LANES, Config, load, save

MAX_INPUT, RECENT_RUNS, DIFF_ROWS, HEAT_TOKENS = 200_000, 8, 8, 30


def playable(text: Column) -> Column:
    """Texts that a dry run takes: not blank, at most 200,000 characters."""
    return F.coalesce((utf16_length(text) <= MAX_INPUT) & (trim(text) != ""), F.lit(False))


def play(docs: DataFrame, config: Config, key: str = "doc_id") -> DataFrame:
    """A dry run: the enabled lanes in turn, with diff, heat map, encodings and preserved blocks, as far as they are shown."""
    rows = docs.where(playable(F.col("text"))).select(key, "text")
    done = steps.cascade(rows, config.tool_lanes, steps.Options(config.intensity, config.gates.fuzzy_dedup), check=config.gates.fidelity)
    done = done.withColumns({"view": udfs.compared("text", "output", config.heatmap), "encodings": udfs.encodings("text"), "preserved": udfs.preserved_blocks("text")})
    done = done.withColumns({"diff": F.col("view.diff"), "heat": F.col("view.heat")}).drop("view")
    return done.withColumns({"diff_omitted": F.col("diff").isNull(), "diff": F.slice(F.filter("diff", lambda s: s["type"] != "same"), 1, DIFF_ROWS), "heat": F.slice("heat", 1, HEAT_TOKENS)})


def every_lane(docs: DataFrame, config: Config, key: str = "doc_id") -> DataFrame:
    """Every lane by itself on the same text, ranked."""
    return measure.ranked_lanes(steps.solo(docs.where(playable(F.col("text"))), [*LANES, "lite"], steps.Options(config.intensity, config.gates.fuzzy_dedup), key), key)


def recent(runs: DataFrame, order: str = "seq") -> DataFrame:
    """The newest runs of the ring, newest first."""
    return measure.newest(runs, RECENT_RUNS, order).orderBy(F.desc(order))


def switch(path: str, on: bool) -> Config:
    """Turn compression on or off in a configuration file."""
    config = replace(load(path), enabled=on)
    save(config, path)
    return config


def status(path: str, runs: DataFrame) -> str:
    """Whether it is on, the strategy, and the totals."""
    config = load(path)
    line = measure.status_line(measure.session_totals(runs)).first()[0]
    return f"{'on' if config.enabled else 'off'} · {config.strategy} · {line}"
