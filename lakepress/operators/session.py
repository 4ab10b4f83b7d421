"""Operators over the blocks of a payload: turns, reference dedup, clearing of old results.

Blocks: payload_id, message, part, kind, text and flags. Groups are counted or reduced
before they are exchanged and joined back, so neither a text that many rows share nor a
long payload is brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepress.functions.text import cleared_marker, content_hash, lines, reference_marker, token_count, utf16_length

MIN_BLOCK_CHARS, MIN_BLOCK_LINES, MIN_CLEARABLE_CHARS = 80, 3, 200


def with_turn_flags(messages: DataFrame, payload: str = "payload_id", index: str = "message", role: str = "role") -> DataFrame:
    """is_newest_user: the last user message; is_current_turn: after the last assistant message (all, if there is none)."""
    last = messages.groupBy(payload).agg(F.max(F.when(F.col(role) == "user", F.col(index))).alias("__u"), F.max(F.when(F.col(role) == "assistant", F.col(index))).alias("__a"))
    joined = messages.join(last.withColumnRenamed(payload, "__p"), F.col(payload).eqNullSafe(F.col("__p")), "left")
    return joined.withColumns({"is_newest_user": F.coalesce(F.col(index) == F.col("__u"), F.lit(False)), "is_current_turn": F.col(index) > F.coalesce("__a", F.lit(-1))}).drop("__p", "__u", "__a")


def eligible(text: Column) -> Column:
    return F.coalesce((utf16_length(text) >= MIN_BLOCK_CHARS) & (F.size(lines(text)) >= MIN_BLOCK_LINES), F.lit(False))


def with_references(blocks: DataFrame) -> DataFrame:
    """Session dedup: later copies of a block in its payload become a marker that names the first; adds output and deduped."""
    fit = eligible(F.col("text")) & ~F.coalesce("is_newest_user", F.lit(False)) & ~F.coalesce("is_current_turn", F.lit(False))
    keyed = blocks.withColumns({"__fit": fit, "__sha": F.sha2(F.encode("text", "UTF-8"), 256), "__at": F.struct("message", "part")})
    first = keyed.where("__fit").groupBy(F.col("payload_id").alias("__p"), F.col("__sha").alias("__s")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    joined = keyed.join(first, F.col("payload_id").eqNullSafe(F.col("__p")) & (F.col("__sha") == F.col("__s")) & F.col("__fit"), "left")
    again = F.coalesce(F.col("__first").isNotNull() & (F.col("__at") != F.col("__first")), F.lit(False))
    marker = reference_marker(content_hash(F.col("text")), F.size(lines(F.col("text"))), utf16_length(F.col("text")))
    return joined.withColumns({"deduped": again, "output": F.when(again, marker).otherwise(F.col("text"))}).drop("__fit", "__sha", "__at", "__p", "__s", "__first", "__n")


def with_cleared(blocks: DataFrame, keep: int = 3, trigger: Column | None = None) -> DataFrame:
    """All but the newest `keep` tool results of a payload over its trigger become a placeholder; adds output and cleared.

    A payload's blocks are numbered in a window by payload: a request is bounded by the provider's context.
    """
    fit = (F.col("kind") == "tool") & ~F.coalesce("is_current_turn", F.lit(False)) & (utf16_length(F.col("text")) >= MIN_CLEARABLE_CHARS)
    if trigger is not None:
        fit = fit & trigger
    fit = F.coalesce(fit, F.lit(False))
    order = Window.partitionBy("payload_id", "__fit").orderBy(F.desc("message"), F.desc("part"))
    ranked = blocks.withColumn("__fit", fit).withColumn("__rank", F.row_number().over(order))
    gone = F.col("__fit") & (F.col("__rank") > keep)
    return ranked.withColumns({"cleared": gone, "output": F.when(gone, cleared_marker(token_count(F.col("text")))).otherwise(F.col("text"))}).drop("__fit", "__rank")
