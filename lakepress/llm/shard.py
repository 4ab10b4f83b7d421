"""Uniform sharding by a hypergeometric communication matrix (DataFrame operations only).

1. Every row gets a random number, fixed by its id, its text and its place in the input,
   and the narrow rows (no texts) are written. The number deals them into partitions of
   about `task_rows` rows, so rows that repeat an id or a text are dealt apart too.
2. Shard sizes are fixed (they differ by one row at most). How many rows of each
   partition go to each shard is drawn exactly: a row of the matrix is a
   multivariate hypergeometric draw from what the shards still lack, so the matrix
   has the partitions' sizes as row sums and the shards' sizes as column sums.
3. Rows are permuted within their partition, the first of them going to the
   first shard and so on, and exchanged.
4. They are permuted again within the shard: dealt into blocks of about
   `task_rows` rows by a second random number, sorted by it within the block; a slot is
   the rows of the blocks before plus the place in the block. That is the order by
   the second number, which is uniform, and no task sorts a whole shard.

Every assignment of rows to shards of those sizes is equally likely, but for the hash
that stands in for randomness: with the same input files it is repeatable after lost
executors, and what is written fixes it for all that follows. The matrix has a row for `task_rows`
rows of input and a column for each shard; nothing else comes to the driver.

Null ids and texts are allowed, a null text has size 8 and the crc32 of no bytes. Rows that repeat
an id and a text are rows of their own. Other columns are not read. An empty table gives an empty
result. The result is a table, which common.dropped() removes.
"""

from __future__ import annotations

import json
import math
from random import Random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakepress.llm import common

#: Rows (of some 40 bytes) that one task permutes; beyond MOST_PARTS partitions they grow with the input, so that the matrix does not.
TASK_ROWS, MOST_PARTS = 2_000_000, 20_000


def hypergeometric(rng: Random, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` of good + bad without replacement: inversion outward from the mode, exact but for rounding."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while u > 0:
        moved = False
        if up < high:
            p_up *= (good - up) / (up + 1) * (draws - up) / (bad - draws + up + 1)
            up += 1
            u -= p_up
            moved = True
            if u <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - draws + down) / (draws - down + 1)
            down -= 1
            u -= p_down
            moved = True
            if u <= 0:
                return down
        if not moved or (p_up < 1e-300 and p_down < 1e-300):
            return mode
    return mode


def matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Exact counts from each row class to each column class; sums of rows and columns must agree."""
    if sum(rows) != sum(columns):
        raise ValueError("the sums of the sizes differ")
    rng, left, out = Random(seed), list(columns), []
    for n in rows:
        rest, draw = sum(left), []
        for k, have in enumerate(left):
            x = hypergeometric(rng, have, rest - have, n)
            draw.append(x)
            rest -= have
            n -= x
            left[k] -= x
        out.append(draw)
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def _table(spark: SparkSession, values: list, kind: str) -> DataFrame:
    """(part, value) as a table to broadcast: one row for each value of a list whose length is bounded by the number of partitions or blocks."""
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")).alias("part", "value"))
    return F.broadcast(rows)


def assign(docs: DataFrame, shards: int = 24, seed: int = 17, task_rows: int = TASK_ROWS) -> DataFrame:
    """For each row: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null: no law by key)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    with common.Scratch() as scratch:
        drawn = scratch.written(rows.select("doc_id", "size", "text_crc32", F.xxhash64("doc_id", "text_crc32", "place", F.lit(seed)).alias("u")), "drawn")
        total = drawn.count()
        parts = max(1, min(MOST_PARTS, math.ceil(total / task_rows)))
        part = F.pmod(F.xxhash64("u", F.lit(1)), F.lit(parts)).cast("int")
        found = {r["part"]: r["n"] for r in drawn.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
        bounds = []
        for draw in matrix([found.get(p, 0) for p in range(parts)], even(total, shards), seed):
            at, line = 0, []
            for n in draw[:-1]:
                at += n
                line.append(at)
            bounds.append(line)

        blocks = max(1, min(MOST_PARTS // shards, math.ceil(total / task_rows / shards)))
        order = [F.xxhash64("u", F.lit(2)), F.col("u")]
        ranked = drawn.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
        shard = F.size(F.filter("value", lambda b: b <= F.col("rank")))  # one step for each shard
        dealt = ranked.join(_table(spark, bounds, "array<bigint>"), "part").select("doc_id", "size", "text_crc32", "u", shard.alias("shard"))
        again = F.xxhash64("u", F.lit(3))
        dealt = scratch.written(dealt.withColumn("block", F.floor(F.pmod(again, F.lit(1 << 30)) * F.lit(blocks) / F.lit(1 << 30)).cast("int")), "dealt")

        sizes = {(r["shard"], r["block"]): r["n"] for r in dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).collect()}  # at most MOST_PARTS rows
        starts = []
        for k in range(shards):
            at = 0
            for b in range(blocks):
                starts.append(at)
                at += sizes.get((k, b), 0)
        order = [F.pmod(again, F.lit(1 << 30)), again, F.col("u")]
        place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
        slots = dealt.withColumn("part", F.col("shard") * blocks + F.col("block")).withColumn("place", place).join(_table(spark, starts, "bigint"), "part")
        return common.written(
            slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("value") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")),
            "shards",
        )
