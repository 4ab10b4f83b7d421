"""What the operators of this subpackage share: folders, batch sizes, checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest pickled model or table that is sent to every executor.
BROADCAST_BYTES = 64 << 20

_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(16 << 20)))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under the one that all executors share, which the cluster names in spark.checkpoint.dir.

    Where the setting is missing, a local master gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lakepress-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lakepress-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: this cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lakepress_path = path
    return back


def owning(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """`df`, which reads these tables as long as it is used; dropped(df) removes them."""
    df._lakepress_tables = tables
    return df


def dropped(df: DataFrame) -> None:
    """Remove a table that written() made, or those that an operator's result reads, by Hadoop's file system, wherever they lie."""
    for table in getattr(df, "_lakepress_tables", ()):
        dropped(table)
    if hasattr(df, "_lakepress_path"):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lakepress_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that an operator writes for itself; they are removed at the end, also after a failure."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        self.tables.append(written(df, what))
        return self.tables[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for table in self.tables:
            dropped(table)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores after it until it is none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and about 16 MB, unless the session has its own sizes: texts are long."""
    for key, usual, value in _BATCHES:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, giving the task's freed memory back to the system: workers are kept for later tasks, and their heaps add up.

    Arrow's own pool keeps what it has freed for itself, so batches are put into the system's.
    """

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def send(spark: SparkSession, value: object, limit: int = BROADCAST_BYTES) -> Broadcast:
    """Broadcast a value after a check of its size."""
    size = len(pickle.dumps(value, protocol=5))
    if size > limit:
        raise ValueError(f"{size} bytes are too many to broadcast; the limit is {limit}")
    return spark.sparkContext.broadcast(value)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long, and text with null as empty; nothing else, so other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def with_bit(df: DataFrame, bucket: Column, buckets: DataFrame, name: str) -> DataFrame:
    """`df` with a boolean column `name`: whether its bucket (a number) is one of `buckets` (one column, distinct).

    The buckets are broadcast as a table of bits, whose size is given by the largest of them (2**24 are 2 MB), whatever their number.
    """
    own, at, bits = free(df.columns, "__b", "__part", "__bits")
    one = buckets.columns[0]
    table = buckets.groupBy(F.bitmap_bucket_number(one).alias(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias(bits))
    found = df.withColumn(own, bucket)
    place = F.bitmap_bit_position(own)
    found = found.withColumn(at, F.bitmap_bucket_number(own)).join(F.broadcast(table), at, "left")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop(at, bits, own)


def with_maybe(df: DataFrame, key: Column, keys: DataFrame, name: str, bits: int = 1 << 24) -> DataFrame:
    """`df` with a boolean column `name`: false only where `key` is none of `keys` (one column).

    Keys share `bits` bits by their hash; one shared by chance gives a true too many, which an exact join must follow.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    return with_bit(df, bucket(key), keys.select(bucket(F.col(keys.columns[0])).alias("__bucket")).distinct(), name)


#: A key with this share of all rows is hot; there are at most as many as its inverse, so their answers can be broadcast.
HOT_SHARE = 1 / 1000


def answered(rows: DataFrame, answers: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """`rows` joined (left) with `answers`, one row for each key; `weight` tells how many rows have it.

    Answers of hot keys are broadcast, at most 1 / HOT_SHARE of them by their definition, so rows of one key
    never meet in one task; the rest is joined by key.
    """
    [mark] = free([*rows.columns, *answers.columns], "__hot")
    is_hot = F.col(weight) >= max(2.0, total * HOT_SHARE)
    hot, cold = answers.where(is_hot), answers.where(~is_hot)
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    columns = [*rows.columns, *[c for c in answers.columns if c not in key]]
    rest = marked.where(F.col(mark).isNull()).select(*rows.columns)
    return marked.where(mark).select(*columns).unionByName(rest.join(cold, key, "left").select(*columns))
