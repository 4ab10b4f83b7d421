"""Token ids of a whole corpus as files: ascending ids, rANS blocks under one frequency table.

1. Rows are dealt by ranges of doc_id (and the text's hash, so that an id that
   many rows share can be split) and sorted. A task tokenises its range and writes
   plain blocks of whole documents, each with its place within the task's range.
2. All ids of all documents are counted; the table has a row for each id of the
   vocabulary at most and is broadcast.
3. Every block is coded on its own and written to the output folder: `blocks` is a
   Parquet table with shard, block, base (ids of the shard before it), doc_ids and counts
   of its documents, payload (see rans.py; not compressed again). `table` holds what a reader
   needs besides: format version, precision, the ids that occur and their frequencies, the end
   id, and the SHA-256 of the vocabulary file. The plain blocks are then removed.
4. read() decodes a folder by its path alone, in any session. Where a shard begins follows from the
   shards' totals, one row for each; a document's start is the sum of three numbers, so
   nothing is ordered globally again.

A document longer than a block is a block of its own. A null or empty text is the end
id alone. Null ids come first. Rows that repeat an id are documents of their own,
ordered by the text's hash. Other columns are not read. An empty table gives empty files
and an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.llm import common, rans, tokens

BLOCK_IDS = 1 << 19
_PLAIN = "shard int, block int, base long, doc_ids array<long>, counts array<long>, ids binary"
_CODED = "shard int, block int, base long, doc_ids array<long>, counts array<long>, payload binary"


VERSION = 1
_TABLE = "version int, precision int, end_id int, vocabulary_sha256 string, ids array<int>, frequencies array<int>"


def _pack(ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"4" if wide else b"2") + ids.astype("<u4" if wide else "<u2").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[:1] == b"4" else "<u2", offset=1)


def _plain_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int, specials: bool) -> DataFrame:
    common.small_batches(docs.sparkSession)
    rows = common.texts(docs).withColumns({"hash": F.xxhash64("text"), "from": F.spark_partition_id()})
    ordered = rows.repartitionByRange("doc_id", "hash", "from").sortWithinPartitions("doc_id", "hash")  # `from` parts rows that repeat both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block = base = size = 0
        names: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            flat = np.concatenate(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([base], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([flat], pa.list_(pa.int64())), pa.array([_pack(np.concatenate(parts))], pa.binary())],
                ["shard", "block", "base", "doc_ids", "counts", "ids"],
            )

        for batch in batches:
            for i, j, ids, bounds in tokens.encode_column(batch.column(1), tokenizer, end_id, specials):
                names += batch.column(0).slice(i, j - i).to_pylist()
                counts.append(np.diff(bounds))
                parts.append(ids.astype(np.uint32))
                size += len(ids)
                if size >= block_ids:
                    yield row()
                    block, base, size = block + 1, base + size, 0
                    names, counts, parts = [], [], []
        if names:
            yield row()

    return ordered.drop("hash", "from").mapInArrow(common.trimmed(run), _PLAIN)


def _count(plain: DataFrame) -> rans.Table:
    """The shared table from the counts of all ids of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for data in batch.column(0):
                found = np.bincount(_unpack(data.as_py()))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = plain.select("ids").mapInArrow(common.trimmed(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary at most
    return rans.Table.from_counts(found["id"].to_numpy(), found["n"].to_numpy())


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS, specials: bool = False) -> str:
    """Tokenise, code and write all documents; returns the folder (`path`, which all executors must share, or a new one)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_path()
    plain = common.written(_plain_blocks(docs, tokenizer, end_id, block_ids, specials), "plain-ids")
    table = _count(plain)
    sent = common.send(spark, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [rans.encode(_unpack(x.as_py()), sent.value) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(coded, pa.binary())], [*batch.schema.names[:5], "payload"])

    path = path or common.shared_folder(spark, "token-files")
    plain.mapInArrow(common.trimmed(run), _CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    with open(tokenizer, "rb") as f:
        vocabulary = hashlib.sha256(f.read()).hexdigest()
    row = (VERSION, rans.PRECISION, end_id, vocabulary, table.symbols.tolist(), table.freq.astype(np.int64).tolist())
    spark.createDataFrame([row], _TABLE).coalesce(1).write.parquet(f"{path}/table")
    common.dropped(plain)
    return path


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files; with `with_ids` its ids as array<int>."""
    common.small_batches(spark)
    coded = spark.read.schema(_CODED).parquet(f"{path}/blocks")
    kept = spark.read.schema(_TABLE).parquet(f"{path}/table").first()  # one row, as long as the vocabulary at most
    if kept["version"] != VERSION or kept["precision"] != rans.PRECISION:
        raise ValueError("the files are of another version")
    sent = common.send(spark, rans.Table(np.array(kept["ids"], np.uint32), np.array(kept["frequencies"], np.uint64)))
    schema = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counts = batch.column(4)[k].values.to_numpy()
                ids = rans.decode(batch.column(5)[k].as_py(), sent.value).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                n = len(counts)
                out = [pa.array(np.full(n, batch.column(0)[k].as_py(), np.int32)), batch.column(3)[k].values, pa.array(bounds[:-1] + batch.column(2)[k].as_py()), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    totals = coded.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    bases, at = [], 0
    for r in totals.orderBy("shard").toLocalIterator():  # one row for each task that wrote
        bases.append((r["shard"], at))
        at += r["n"]
    base = spark.range(1).select(F.explode(F.from_json(F.lit("[" + ",".join(f'{{"s":{s},"b":{b}}}' for s, b in bases) + "]"), "array<struct<s:int,b:bigint>>")).alias("x")).select(F.col("x.s").alias("shard"), F.col("x.b").alias("b"))
    found = coded.mapInArrow(common.trimmed(run), schema).join(F.broadcast(base), "shard")
    return found.select("doc_id", (F.col("b") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
