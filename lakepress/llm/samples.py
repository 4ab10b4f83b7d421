"""Bounded samples of labelled rows, and training on them in one task, so that the driver holds neither."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.llm import common


def unit(*columns: Column | str, seed: int = 41) -> Column:
    """A fixed number in [0, 1) for each combination of values."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def trained(sample: DataFrame, order: list[str], train: Callable[[pa.Table], object]) -> object | None:
    """What `train` makes of the sample's rows in their order, in one task on an executor; only the model comes back. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            held.clear()
            model = train(rows.sort_by([(k, "ascending") for k in order]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(common.trimmed(run), "model binary").collect()
    return pickle.loads(made[0][0]) if made else None


def fitted(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, modulus: int, held_out: int, train: Callable[[list[str], np.ndarray, float], object]) -> object:
    """The model that `train` makes of whole texts, their labels, and the share of label 1 among all that may be learned from.

    The sample is bounded by two parameters: at most about `rows` rows and `size` bytes of text.
    Classes are counted over all labelled ids outside the held-out fold; an id with both labels is not
    learned from. Ids are then chosen class by class by their hash and sent to the texts as a
    broadcast of bounded size. Rows that repeat id and text count once; where an id has so many texts, or
    texts are so long, that a bound is passed, rows are chosen by the hash of id and text.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.where(common.fold(F.col("doc_id"), modulus) != held_out)
    own = own.groupBy("doc_id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__most")).where(F.col("__y") == F.col("__most")).drop("__most")
    found = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if not found:
        return train([], np.zeros(0, np.int64), 0.0)
    total = sum(found.values())
    half, share = rows // 2, found.get(1, 0) / total
    want = {y: min(n, max(half, rows - (total - n))) for y, n in found.items()}
    rate = F.lit(0.0)
    for y, n in found.items():
        rate = F.when(F.col("__y") == y, F.lit(want[y] / n)).otherwise(rate)
    chosen = own.where(unit("doc_id") < rate).limit(rows + rows // 8)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    got = got.join(F.broadcast(chosen), "doc_id").withColumn("__h", F.xxhash64("text"))
    held = common.written(got.dropDuplicates(["doc_id", "__h"]), "sample")
    try:
        have = held.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
        part = min(1.0, (rows + rows // 8) / max(1, have["n"]), size / max(1, have["b"] or 0))
        sample = held.where(unit("doc_id", "__h", seed=43) < part) if part < 1 else held
        model = trained(sample, ["doc_id", "__h"], lambda t: train(t["text"].to_pylist(), t["__y"].to_numpy().astype(np.int64), share))
    finally:
        common.dropped(held)
    return train([], np.zeros(0, np.int64), share) if model is None else model
