"""Helpers shared by the corpus operators."""
from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one window task may have to order.
ROWS_PER_SLICE = 500_000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, rows: int,
             per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Number the rows of each group without a gap from 0, in `name`, without a task that holds a group.

    Each group is cut by the hash of `order` into slices, slices are numbered inside, and the row
    counts of earlier slices are added. `rows` is the row count of df and fixes the number of slices.
    Rows equal in `order` stay in one slice, so `order` should nearly be a key. Group values must not be null.
    """
    slices = max(1, math.ceil(rows / per_slice))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    keys = [*group, "_slice"]
    inside = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = cut.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    if slices == 1:
        return ranked.drop("_slice")
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranked.join(starts, keys).withColumn(name, F.col(name) + F.col("_start")).drop("_slice", "_start")


def hash_sample(df: DataFrame, column: str, size: int) -> DataFrame:
    """About `size` rows, those whose hash of a column is below a limit: a bounded sample for fitting, the same in every run."""
    rows = df.count()
    if rows <= size:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(column), F.lit("sample")), F.lit(1 << 40)) < F.lit(int((1 << 40) * size / rows)))


def trimmed() -> None:
    """Give what a task has freed back to the system: its worker stays, and other operators' tasks come to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


class WordHash(dict):
    """Word to 64-bit hash, kept for the words met most recently; memory is bounded by LIMIT entries."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


#: Odd multipliers, one per place in a shingle; from a fixed generator.
PLACES = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n-word window, in order; a shorter text is one window."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for place in range(n):
        out += hashes[place:len(hashes) - n + 1 + place] * PLACES[place]
    out ^= out >> np.uint64(32)
    out *= PLACES[-1]
    return out ^ (out >> np.uint64(29))
