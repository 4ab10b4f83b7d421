"""Run and debug logs as append-only JSON or Parquet tables, and their rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakepress.operators import measure

RUN_LIMIT, RUN_KEEP = 5 << 20, 1 << 20
DEBUG_LIMIT, DEBUG_KEEP = 25 << 20, 2 << 20
RUNS = "ts long, seq long, model string, api string, strategy string, original_tokens long, compressed_tokens long, savings_percent double, duration_ms double, accepted boolean, fallback_reason string"


def append(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Add rows to a log; each call adds files and changes none."""
    rows.write.mode("append").format(kind).save(path)


def read_runs(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(RUNS).format(kind).load(path)


def rotate(spark: SparkSession, path: str, into: str, max_bytes: int = RUN_LIMIT, keep_bytes: int = RUN_KEEP) -> DataFrame:
    """Write what rotation keeps of a log of lines (text files with `n` and `line` as JSON) to a new place and return it."""
    rows = spark.read.schema("n long, line string").json(path)
    measure.kept_after_rotation(rows, max_bytes, keep_bytes).write.mode("overwrite").json(into)
    return spark.read.schema("n long, line string").json(into)
