"""Small helpers of the text operators."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# An Arrow batch that goes to Python holds about so many bytes, however long its texts are.
BATCH_BYTES = 8 << 20

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# A-Z become a-z; every ASCII byte that is neither letter nor digit becomes a space.
ALNUM_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in ASCII_LOWER)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches sent to Python by bytes, as a row can be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers live on between tasks and operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with the GNU C library
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives back what earlier tasks left, and its own when it ends."""
    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def let_go(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted before the next large one.

    Spark deletes them once nothing in the driver refers to them, which it only learns
    from a garbage collection; a driver that does little may not have one for long.
    """
    for _ in range(2):  # what Python let go of is let go in the JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def bytes_of(text: str) -> Column:
    """The UTF-8 bytes of a string column; null stays null."""
    return F.col(text).cast("binary")


def alnum_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased; none of null."""
    return bytes(data).translate(ALNUM_WORDS).split() if data else []


def spaced_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased; none of null."""
    return bytes(data).translate(ASCII_LOWER).split() if data else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
