"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows to the shared folder and reads them again for the next one, so a lost
executor costs one stage at most. All stages but the last return the columns of
`documents` as they are; the last returns the packed pieces. What a stage or an
operator writes on the way is removed when the next stage is written.

A null text counts as empty: it is not toxic, one document of all empty ones stays (the
largest id, nulls smallest), it is no near copy of others and is packed as the end id.
Null ids are ids like others. Rows that repeat id and text become one in exact dedup. Very long
texts are read whole. Extra columns are kept whatever their names, until packing. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakepress.llm import common, decontaminate, exact_dedup, near_dedup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the model learns from all documents and labels of `sf_dir`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact_dedup.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return near_dedup.distinct(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Training and tokenising can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, made = docs, stage(spark, docs, sf_dir)
        docs = common.written(made, f"stage-{name}")
        common.dropped(made)
        if k:
            common.dropped(before)
    return docs
