"""Compression engines as DataFrame transforms, the cascade over them, and the gates around it.

An engine adds columns for its output, techniques, rules and skip reason; a step
keeps the output only if it has fewer tokens, and appends itself to the array
`steps`. Nothing here exchanges rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.functions import lanes as python
from lakepress.functions import logs, udfs
from lakepress.functions.text import savings_percent, token_count
from lakepress.plans.config import Config

STEP = (
    "struct<engine:string,input:string,output:string,original_tokens:bigint,compressed_tokens:bigint,savings_percent:double,"
    "techniques:array<string>,rules:array<string>,rejected:boolean,reject_reason:string>"
)
_NONE = "array<string>"


@dataclass(frozen=True)
class Options:
    intensity: str = "full"
    fuzzy: bool = True
    #: Tokens of a text, as a column (run_step) and as a function (cascades); both should say the same.
    tokens: Callable[[Column], Column] = token_count
    count: Callable[[str], int] = python.tokens


#: (df, text column, output column, options) -> df with output, `<output>_tech`, `<output>_rules`, `<output>_skip`.
Apply = Callable[[DataFrame, str, str, Options], DataFrame]


def _noted(df: DataFrame, out: str, techniques: Column | None = None, rules: Column | None = None, skip: Column | None = None) -> DataFrame:
    empty = F.array().cast(_NONE)
    return df.withColumns(
        {
            f"{out}_tech": F.coalesce(techniques, empty) if techniques is not None else empty,
            f"{out}_rules": F.coalesce(rules, empty) if rules is not None else empty,
            f"{out}_skip": skip if skip is not None else F.lit(None).cast("string"),
        }
    )


def _named(condition: Column, name: str) -> Column:
    return F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast(_NONE))


def _dedup(df: DataFrame, text: str, out: str, o: Options) -> DataFrame:
    if o.fuzzy:
        df = df.withColumn("__d", udfs.drop_similar_blocks(F.col(text), True))
        df = df.withColumns({out: F.col("__d.output"), "__n": F.col("__d.removed")}).drop("__d")
    else:
        df = logs.with_deduplicated_blocks(df, text, out, "__n")
    return _noted(df, out, _named(F.col("__n") > 0, "session-dedup")).drop("__n")


def _truncate(df: DataFrame, text: str, out: str, o: Options) -> DataFrame:
    df = logs.with_truncated(df, text, out, "__n").drop("__n")
    return _noted(df, out, _named(F.col(out) != F.col(text), "rtk-truncate"))


def _rtk(df: DataFrame, text: str, out: str, o: Options) -> DataFrame:
    """Filter, collapse runs, strip comments in fences, truncate; plain documents are left alone."""
    shell = F.coalesce(F.col("is_shell_tool"), F.lit(False)) if "is_shell_tool" in df.columns else F.lit(False)
    df = df.withColumn("__aware", logs.is_command_aware(F.col(text), shell))
    df = df.withColumn("__skip", ~F.col("__aware") & ~logs.has_error(F.col(text)))
    df = df.withColumn("__in", F.when(~F.col("__skip"), F.col(text)))  # skipped texts cost nothing below
    df = logs.with_filtered_lines(df, "__in", "__f0").withColumn("__f", F.when(F.col("__aware"), F.col("__f0")).otherwise(F.col("__in")))
    df = logs.with_collapsed_runs(df, "__f", "__r")
    df = df.withColumn("__c", F.when(F.contains("__r", F.lit("```")), udfs.strip_comments(F.when(F.contains("__r", F.lit("```")), F.col("__r")))).otherwise(F.col("__r")))
    df = logs.with_truncated(df, "__c", "__t", "__n")
    parts = [_named(F.col(a) != F.col(b), n) for a, b, n in (("__in", "__f", "rtk-filter"), ("__f", "__r", "rtk-dedup"), ("__r", "__c", "rtk-code-strip"))]
    techniques = F.when(F.col("__skip"), F.array().cast(_NONE)).otherwise(F.concat(*parts, _named(F.col("__n") > 0, "rtk-truncate")))
    df = df.withColumn(out, F.when(F.col("__skip"), F.col(text)).otherwise(F.col("__t")))
    return _noted(df, out, techniques, skip=F.when(F.col("__skip"), "document")).drop("__aware", "__skip", "__in", "__f0", "__f", "__r", "__c", "__t", "__n")


def _prose(df: DataFrame, text: str, out: str, o: Options) -> DataFrame:
    df = df.withColumn("__p", udfs.condense(F.col(text), o.intensity))
    df = df.withColumn(out, F.col("__p.output"))
    return _noted(df, out, F.col("__p.techniques"), F.col("__p.rules"), F.col("__p.skipped")).drop("__p")


def _lite(df: DataFrame, text: str, out: str, o: Options) -> DataFrame:
    return _prose(df, text, out, Options("lite", o.fuzzy, o.tokens))


#: The engines as columns, for run_step; more may be added.
ENGINES: dict[str, Apply] = {"dedup": _dedup, "rtk": _rtk, "truncate": _truncate, "caveman": _prose, "lite": _lite}


def run_step(df: DataFrame, engine: str, options: Options = Options(), text: str = "text") -> DataFrame:
    """Apply one engine to `text`, by built-in expressions where they can say it; append the step to `steps`, take its output."""
    if "steps" not in df.columns:
        df = df.withColumn("steps", F.array().cast(f"array<{STEP}>"))
    df = df.withColumn("__text", F.col(text))
    df = ENGINES[engine](df, "__text", "__o", options)
    df = df.withColumns({"__a": options.tokens(F.col("__text")), "__b": options.tokens(F.col("__o"))})
    skip = F.col("__o_skip")
    none = skip.isNull() & (F.col("__b") >= F.col("__a"))
    lost = skip.isNotNull() | none
    after = F.when(lost, F.col("__a")).otherwise(F.col("__b"))
    step = F.struct(
        F.lit(engine).alias("engine"),
        F.col("__text").alias("input"),
        F.when(lost, F.col("__text")).otherwise(F.col("__o")).alias("output"),
        F.col("__a").alias("original_tokens"),
        after.alias("compressed_tokens"),
        savings_percent(F.col("__a"), after).alias("savings_percent"),
        F.col("__o_tech").alias("techniques"),
        F.when(F.col("__o") == F.col("__text"), F.array().cast(_NONE)).otherwise(F.col("__o_rules")).alias("rules"),
        lost.alias("rejected"),
        F.when(skip.isNotNull(), skip).when(none, "no-gain").alias("reject_reason"),
    )
    df = df.withColumn("__step", step)
    used = F.col("__text").isNotNull()
    df = df.withColumn("steps", F.when(used, F.concat("steps", F.array(F.col("__step").cast(STEP)))).otherwise(F.col("steps")))
    df = df.withColumn(text, F.when(used, F.col("__step.output")).otherwise(F.col(text)))
    return df.drop("__text", "__o", "__o_tech", "__o_rules", "__o_skip", "__a", "__b", "__step")


def cascade(df: DataFrame, lanes: Iterable[str], options: Options = Options(), check: bool | python.Check = False) -> DataFrame:
    """Lane after lane, each on the output of the one before, in one pass: adds output and steps.

    Lanes are names of functions/lanes.ENGINES; an unknown one is an error. `check`: True takes steps back that lose
    facts; a function from the texts before and after a step gives the reason to take it back, or None.
    """
    order, intensity, fuzzy, count = python.known(list(lanes)), options.intensity, options.fuzzy, options.count

    def run(text: pd.Series, shell: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if t is None else python.cascade(t, order, bool(s), intensity, fuzzy, check, count) for t, s in zip(text, shell)]
        return pd.DataFrame(rows, columns=["output", "steps"])

    shell = F.col("is_shell_tool") if "is_shell_tool" in df.columns else F.lit(False)
    once = F.pandas_udf(run, f"output string, steps array<{STEP}>").asNondeterministic()  # a filter on its result must not run it again
    done = df.withColumn("__c", once(F.col("text"), F.coalesce(shell, F.lit(False))))
    return done.withColumns({"output": F.col("__c.output"), "steps": F.col("__c.steps")}).drop("__c")


def solo(df: DataFrame, lanes: Iterable[str], options: Options = Options(), key: str = "doc_id") -> DataFrame:
    """Every lane by itself on the same text, in one pass: a row for each key and lane, with the step's fields. Null texts have none."""
    order, intensity, fuzzy, count = python.known(list(lanes)), options.intensity, options.fuzzy, options.count

    def run(text: pd.Series, shell: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [python.step(lane, t, bool(s), intensity, fuzzy, count=count) for lane in order] for t, s in zip(text, shell)], dtype=object)

    shell = F.col("is_shell_tool") if "is_shell_tool" in df.columns else F.lit(False)
    once = F.pandas_udf(run, f"array<{STEP}>").asNondeterministic()
    steps = df.select(key, once(F.col("text"), F.coalesce(shell, F.lit(False))).alias("__s"))
    return steps.select(key, F.posexplode("__s").alias("lane_no", "__s")).select(key, "lane_no", "__s.*")


def compress_blocks(df: DataFrame, config: Config) -> DataFrame:
    """Blocks (text, kind, is_shell_tool) with gates around the cascade: adds output, steps, accepted, reason.

    Risk spans, then high-entropy spans are replaced by numbered places; lanes run by kind, each step
    checked for facts; spans go back in. A block keeps its text unless every place came through exactly once
    and the result is shorter in characters and tokens.
    """
    gates, intensity = config.gates, config.intensity
    lanes = {"tool": list(config.tool_lanes), "user": list(config.user_lanes)}

    def run(text: pd.Series, kind: pd.Series, shell: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, s in zip(text, kind, shell):
            if t is None:
                rows.append((None, [], "null"))
                continue
            done = python.gated(t, lanes["tool" if k == "tool" else "user"], bool(s), intensity, gates.fidelity, gates.risk, gates.quantum, gates.fuzzy_dedup)
            rows.append((done.output, done.steps, done.reason))
        return pd.DataFrame(rows, columns=["output", "steps", "reason"])

    once = F.pandas_udf(run, f"output string, steps array<{STEP}>, reason string").asNondeterministic()
    done = df.withColumn("__c", once(F.col("text"), F.col("kind"), F.coalesce("is_shell_tool", F.lit(False))))
    done = done.withColumns({"output": F.col("__c.output"), "steps": F.col("__c.steps"), "reason": F.col("__c.reason")}).drop("__c")
    return done.withColumn("accepted", F.col("reason").isNull())


def once_for_equal(df: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], results: list[str]) -> DataFrame:
    """Compute each distinct combination of `keys` once and join the results back, as a memo would.

    Copies cost a hash; the join has one row for each key on the other side, so a text that many rows share is split.
    """
    hashed = df.withColumn("__memo", F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0001")) for k in keys]), 256))
    done = compute(hashed.dropDuplicates(["__memo"]).select("__memo", *keys)).select("__memo", *results)
    return hashed.join(done, "__memo", "left").drop("__memo")


def waterfall(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each step with its place, label and summary."""
    from lakepress.functions.text import step_label

    rows = df.select(key, F.posexplode("steps").alias("step_no", "s"))
    return rows.select(key, "step_no", "s.engine", "s.original_tokens", "s.compressed_tokens", "s.savings_percent", "s.rejected", "s.reject_reason", step_label(F.col("s.engine"), F.col("s.savings_percent")).alias("label"))
