"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. Rows are counted by their length in bytes. Rows whose length occurs once are out.
2. The others are counted by length and the hash of their first characters. Pairs
   that occur once are out.
3. What survives gets the SHA-256 of its whole text and is grouped by it and the
   length; the others are groups of one.

What survives a pass is told to the rows as a broadcast table of bits, one bit for each
value modulo the table's size, set where at least two rows fell; a bit shared by chance
only lets a row survive that need not, so results are exact whatever the size. Lengths have
LENGTH_BITS bits; pairs have SPARE bits for each row that reached them, up to MOST_BITS
(16 MB). Beyond MOST_BITS / SPARE rows the second table fills: with r rows a share
of 1 - exp(-r / MOST_BITS) of lone rows is hashed in full too, which costs a scan and no exchange.

Null counts as the empty text. Of equal texts the row with the largest doc_id
stays (a null id is smaller than any). Rows that repeat both id and text get
the same answer from groups(); distinct() returns one of them, and all its columns as they
were, whatever their names. An empty table gives an empty result. Groups are counted before
the exchange; answers of large groups come back to their rows by a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.llm import common

PREFIX = 256
LENGTH_BITS = 1 << 20
SPARE, MOST_BITS = 16, 1 << 27


def _digest(text: str) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _survivors(docs: DataFrame, prefix: int, most_bits: int, names: list[str]) -> tuple[DataFrame, int]:
    """`docs` with text, length and whether another row may share both length and prefix hash, under these three names; and the number of rows."""
    text, n, many = names
    [some] = common.free([*docs.columns, *names], "__some")
    sized = docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))).withColumn(n, F.octet_length(text).cast("long"))
    place = F.col(n) % LENGTH_BITS
    lengths = sized.groupBy(place.alias("place")).agg(F.count("*").alias("rows"))
    told = lengths.agg(F.sum("rows").alias("all"), F.sum(F.when(F.col("rows") > 1, F.col("rows"))).alias("again")).first()
    first = common.with_bit(sized, place, lengths.where("rows > 1").select("place"), some)

    bits = min(most_bits, 1 << max(16, ((told["again"] or 1) * SPARE - 1).bit_length()))
    bucket = F.pmod(F.xxhash64(n, F.xxhash64(F.substring(text, 1, prefix))), F.lit(bits))
    pairs = first.where(some).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows")).where("rows > 1").select("bucket")
    second = common.with_bit(first, F.when(F.col(some), bucket), pairs, many)
    return second.drop(some), told["all"] or 0


def _answers(rows: DataFrame, text: str, n: str, many: str) -> DataFrame:
    return rows.where(many).groupBy(F.col(n).alias("n"), _digest(text).alias("sha")).agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))


def groups(docs: DataFrame, prefix: int = PREFIX, most_bits: int = MOST_BITS, digest_all: bool = False) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256.

    A row that is alone by length or prefix has no digest, as its text is not
    read in full, unless `digest_all`; it is then hashed where it lies. The result reads a table
    without texts, which common.dropped() removes.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, total = _survivors(own, prefix, most_bits, ["own", "n", "many"])
    keyed = common.written(rows.select("doc_id", "n", "many", (_digest("own") if digest_all else F.when(F.col("many"), _digest("own"))).alias("sha")), "digests")
    answers = keyed.where("many").groupBy("n", "sha").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
    alone = keyed.where(~F.col("many")).select("doc_id", "sha", F.col("doc_id").alias("keep"), F.lit(1).cast("long").alias("size"))
    some = common.answered(keyed.where("many").select("doc_id", "n", "sha"), answers, ["n", "sha"], "size", total)
    found = alone.unionByName(some.select("doc_id", "sha", "keep", "size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep"))
    return common.owning(found.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256")), keyed)


def distinct(docs: DataFrame, prefix: int = PREFIX, most_bits: int = MOST_BITS) -> DataFrame:
    """The documents that stay, with their columns; texts of rows that are alone are not exchanged."""
    text, n, many, sha, key = common.free(docs.columns, "__text", "__n", "__many", "__sha", "__key")
    rows, _ = _survivors(docs, prefix, most_bits, [text, n, many])
    alone = rows.where(~F.col(many)).select(*docs.columns)
    some = rows.where(many).withColumn(sha, _digest(text)).withColumn(key, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    keep = _answers(rows.withColumn("doc_id", F.col("doc_id").cast("long")), text, n, many)
    stay = keep.select(F.col("n").alias(n), F.col("sha").alias(sha), F.coalesce(F.col("keep").cast("string"), F.lit("")).alias(key))
    kept = some.join(stay, [n, sha, key], "left_semi").dropDuplicates([n, sha, key])
    return alone.unionByName(kept.select(*docs.columns))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
