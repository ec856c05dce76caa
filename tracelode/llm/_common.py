"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space, the separators of words: the set that bytes.split() uses as well.
SPACES = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else unchanged."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key's decimal text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def bounded_batches(spark: SparkSession, rows: int = 2_000, size: str | None = None) -> None:
    """Have Spark send texts to Python in batches of so many rows, and of that size where one is given: an executor holds
    several copies of each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracelode-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tracelode-{uuid.uuid4().hex}"


#: Has Spark delete the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "t", compression: str = "snappy", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut, lost executors cost nothing, and the shuffle
    files of the writing are deleted with it and not at some later collection."""
    spark = df.sparkSession
    path, before = f"{scratch(spark)}/{name}", spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression, partitionBy=list(partition_by))
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame, part: str = "") -> None:
    """Delete a stored table, or one of its partitions, that no later step reads."""
    jvm = table.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path("/".join(filter(None, (table.scratch_path, part))))
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a bitmap, 64 to a row: at most 524,288 rows of two numbers, however many values are set.
BITMAP = 1 << 25


def bitmap(values: DataFrame) -> DataFrame:
    """Rows (slot, bits) of a bitmap of the hashes in column h: a filter of bounded size, to be sent to all tasks. It
    lets through every value that was set, and a share of others that nears one only as the bitmap fills."""
    slot = F.floor(F.pmod("h", F.lit(BITMAP)) / 64).cast("int")
    return stored(values.select(slot.alias("slot"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")), "bitmap")


def in_bitmap(df: DataFrame, h: str, bits: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose hash h may be in the bitmap; how='left_anti': the others, which certainly are not."""
    held = F.getbit(bits["bits"], F.pmod(df[h], F.lit(64)).cast("int")) == 1
    return df.join(F.broadcast(bits), (F.floor(F.pmod(df[h], F.lit(BITMAP)) / 64).cast("int") == bits["slot"]) & held, how)


def give_back(result=None):
    """Return memory that is free inside this Python worker to the system, and the result: idle workers stay beside their
    executor, and those of the next stage must fit in as well."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)
    return result


def frugal(run):
    """A function of batches that gives memory back when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype=dtype)
