"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step hangs nodes below the smallest neighbour they know, until every
component is a star around its smallest node; the number of rounds grows with
the logarithm of the components' size. A node's neighbours are never brought
together: a step takes a minimum (counted before the exchange) and joins it
back, and adaptive execution splits the rows of a large node, for the other
side has one row for each node. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm import common


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label) of every node that has an edge; edges: two columns of one orderable type; the label is the smallest node.

    The result reads a table, which common.dropped() removes.
    """
    u, v = edges.columns[:2]
    now = common.written(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a != b").distinct(), "edges")
    mark = _fingerprint(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        new = common.written(_small(_large(now)), "edges")
        common.dropped(now)
        now, before = new, mark
        mark = _fingerprint(now)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    return common.owning(found, now)
