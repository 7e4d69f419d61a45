"""Shared helpers: table access, hashing, filters of ids; written intermediates come from the library's store."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import appended, discard, materialize

__all__ = ["appended", "bloom", "bloom_block", "bloom_mask", "crc_bucket", "discard", "fraction_filter", "freeing", "materialize", "small_batches", "split_by_ids", "table"]

#: Bits of an id filter per id, and the most blocks of 64 bits (a broadcast of some 8 MB).
#: With more ids the blocks fill up and let more rows through; exact joins follow.
FILTER_BITS_PER_ID, MAX_FILTER_BLOCKS = 16, 1 << 18
#: Bytes of a batch of rows on its way to a worker, which the JVM and the worker both hold.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the fixed split into folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def fraction_filter(fraction: float, *cols: str) -> Column:
    """A repeatable hash sample of the given fraction."""
    scale = 1_000_003
    return F.pmod(F.xxhash64(*cols), F.lit(scale)) < F.lit(max(1, round(fraction * scale)))


def small_batches(spark: SparkSession) -> None:
    """Batches of this session's rows to workers go by BATCH_BYTES from now on, not by ten thousand rows of any length.

    It must hold when a result is written, which is up to the caller, so it is not set back.
    """
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    now = spark.conf.get(_BATCH, "64m").lower().removesuffix("b")
    if int(now.rstrip("kmg")) * unit.get(now[-1:], 1) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def freeing(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, with what it keeps in its worker given back at the end of a task.

    Workers serve one stage after another and wait through those of the JVM; tables that they
    kept, and freed memory that their allocators hold, would add up.  forget is a function of
    a module, since only those reach the worker's own tables.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            _give_back()

    return task


def _give_back() -> None:
    """Return freed memory of Arrow and, where it is the GNU one, of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_mask(key: Column) -> Column:
    """Four bits of a 64-bit block, from independent parts of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    bit = []
    for shift in (0, 6, 12, 18):
        at = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        bit.append(F.call_function("shiftleft", one, at))
    return bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2]).bitwiseOR(bit[3])


def bloom(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """(block, word): a blocked Bloom filter of a key, one row for each block that is not empty."""
    return keys.select(bloom_block(key, blocks).alias("block"), bloom_mask(key).alias("m")).groupBy("block").agg(F.bit_or("m").alias("word"))


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is surely not among ids, and the others, which need an exact test.

    A blocked Bloom filter (MAX_FILTER_BLOCKS rows at most, broadcast) tells them apart in a
    narrow scan, so that rows which no id concerns are in no shuffle.
    """
    blocks, n = 1, ids.count()
    while blocks * 64 < n * FILTER_BITS_PER_ID and blocks < MAX_FILTER_BLOCKS:
        blocks *= 2
    bits = bloom(ids, F.col(id_col), blocks).select(F.col("block").alias("__qg_block"), F.col("word").alias("__qg_word"))
    key = F.col(f"`{id_col}`")
    met = df.join(F.broadcast(bits), bloom_block(key, blocks) == F.col("__qg_block"), "left")
    hit = F.coalesce(F.col("__qg_word").bitwiseAND(bloom_mask(key)) == bloom_mask(key), F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return met.where(~hit).select(*own), met.where(hit).select(*own)
