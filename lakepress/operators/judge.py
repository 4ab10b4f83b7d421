"""Judged pairs: a pluggable judge called in order under a cost cap, and fact recovery.

The judge is any callable from a prompt to (reply, input tokens, output tokens); without one
nothing is called. Calls go one after the other on the driver, because the cap decides on each
from the costs before it; verdicts and recall are computed as columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.functions import udfs
from lakepress.functions.text import verdict
from lakepress.operators.measure import with_recall

Judge = Callable[[str], tuple[str, int, int]]


@dataclass(frozen=True)
class Prices:
    input: float
    output: float


def _ask(pairs: DataFrame, judge: Judge | None, prices: Prices, cap: float, prompt: Callable[[dict], str], free: Column) -> DataFrame:
    """`pairs` with reply, usd, capped and error: all in the order of their ids until the cap, the rest are capped; `free` ones reply nothing and cost nothing."""
    rows, total = [], 0.0
    asked = pairs.where(~free).orderBy("id").toLocalIterator() if judge and total < cap else iter(())
    for row in asked:
        pair = row.asDict()
        reply, usd, error = None, 0.0, None
        try:
            reply, n_in, n_out = judge(prompt(pair))  # type: ignore[misc]
            usd = n_in / 1e6 * prices.input + n_out / 1e6 * prices.output
            total += usd
        except Exception as e:  # a failed call is an answer of its own
            error = str(e)[:200]
        rows.append((pair["id"], True, reply, usd, error))
        if total >= cap:
            break
    told = pairs.sparkSession.createDataFrame(rows, "__id long, __told boolean, reply string, usd double, error string")
    joined = pairs.join(told, pairs["id"].eqNullSafe(told["__id"]) & ~free, "left")
    skipped = F.when(F.lit(judge is not None), ~free & F.col("__told").isNull())
    done = joined.withColumns({"reply": F.when(free, "").otherwise(F.col("reply")), "usd": F.when(free | skipped, 0.0).otherwise(F.col("usd")), "capped": F.when(free, False).otherwise(skipped)})
    return done.select(*pairs.columns, "reply", "usd", "capped", "error")


def fidelity_batch(pairs: DataFrame, judge: Judge | None, prices: Prices, cap: float = 0.1) -> DataFrame:
    """Pairs (id, original, compressed) with reply, usd, capped, error and verdict."""
    ask = lambda p: f"Does B say the same as A? End with 'verdict: same' or 'verdict: materially differs'.\nA:\n{p['original']}\nB:\n{p['compressed']}"
    return _ask(pairs, judge, prices, cap, ask, F.lit(False)).withColumn("verdict", F.when(F.col("reply").isNotNull(), verdict(F.col("reply"))))


def recovery_batch(pairs: DataFrame, judge: Judge | None, prices: Prices, cap: float = 0.1) -> DataFrame:
    """Which facts of `original` the judge reads out of `compressed`; pairs without facts score 100 and cost nothing."""
    rows = pairs.withColumn("needles", udfs.critical_needles("original"))
    ask = lambda p: f"List, one per line, every URL, version, file path and code identifier of this text, and nothing else.\n{p['compressed']}"
    told = _ask(rows, judge, prices, cap, ask, F.size("needles") == 0)
    scored = with_recall(told.withColumn("__answer", F.coalesce("reply", F.lit(""))), "__answer")
    known = F.col("reply").isNotNull()
    return scored.withColumns({"recall_percent": F.when(known, F.col("recall_percent")), "missed": F.when(known, F.col("missed"))}).drop("__answer")
