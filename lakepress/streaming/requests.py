"""Requests as a stream: decisions batch by batch, and running totals.

Every operator works within a request, so batches need no state; totals are a streaming
aggregation by session, or a ring of the newest runs held as state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakepress.operators import payload
from lakepress.operators.measure import RING
from lakepress.plans.config import Config

REQUESTS = "payload_id long, api string, payload string"
USAGE = "session string, input long, output long, cache_read long, cache_write long"
RUNS = "session string, seq long, accepted boolean, original_tokens long, compressed_tokens long"


def read(spark: SparkSession, path: str, schema: str = REQUESTS, kind: str = "json") -> DataFrame:
    """Files that arrive in a folder."""
    return spark.readStream.schema(schema).format(kind).load(path)


def decide_stream(requests: DataFrame, config: Config, sink: Callable[[DataFrame, int], None], checkpoint: str, debug: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """One decision for each request; `sink` (and `debug`, if asked for) gets each batch with its number, so a repeated batch can be told."""

    def batch(rows: DataFrame, number: int) -> None:
        done = payload.decide(rows, config).persist()
        try:
            sink(done, number)
            if debug is not None and config.debug:
                debug(done, number)
        finally:
            done.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(usage: DataFrame) -> DataFrame:
    """Running sums by session; for update or complete mode."""
    return usage.groupBy("session").agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in ("input", "output", "cache_read", "cache_write")])


def ring_totals_stream(runs: DataFrame, size: int = RING) -> DataFrame:
    """Totals over each session's newest `size` runs, held as state of bounded size."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for rows in batches:
            held += list(zip(rows["seq"].tolist(), rows["accepted"].tolist(), rows["original_tokens"].tolist(), rows["compressed_tokens"].tolist()))
            held = sorted(held)[-size:]
        state.update(tuple(list(x) for x in zip(*held)))
        hit = [h for h in held if h[1]]
        yield pd.DataFrame({"session": [key[0]], "requests": [len(held)], "accepted": [len(hit)], "original_tokens": [sum(h[2] for h in hit)], "compressed_tokens": [sum(h[3] for h in hit)]})

    return runs.groupBy("session").applyInPandasWithState(
        update,
        "session string, requests long, accepted long, original_tokens long, compressed_tokens long",
        "seq array<long>, accepted array<boolean>, original_tokens array<long>, compressed_tokens array<long>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
