"""Word tables shared by the operators that read whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's hash table before it starts anew; bounds its memory.
CACHE_WORDS = 200_000
#: Bytes of an Arrow batch, and of the texts worked on at once; a longer text comes alone.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows and BATCH_BYTES at most, so that long texts fit a Python worker.

    Plans read these settings when they run, so they stay lowered in the session; they change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is not None and not 0 < int(now.rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column of bytes holds `most` at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: What empties the tables that operators keep in a worker from task to task.
KEEPERS: list[Callable[[], None]] = []


def lean(work: Callable, keeper: Callable[[], None] | None = None) -> Callable:
    """`work` on batches without cycle collection; at its end the worker gives its free memory back, as workers outlive their tasks.

    Tables that other operators have kept in the worker go first; `keeper` empties the operator's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forget in KEEPERS:
            if forget is not keeper:
                forget()
        gc.disable()
        try:
            yield from work(batches)
        finally:
            gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library frees by its own rules
            pass

    return run


def utf8(col: str) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


class Hashes(dict):
    """word -> 64-bit hash, filled on demand and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


#: Odd multipliers, one for each place in a shingle.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (0xC2B2AE3D27D4EB4F << (i % 7))) % 2**64 | 1 for i in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of `width` words; the whole run if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        total += hashes[i : n - k + 1 + i] * PLACES[i]
    return mix(total + np.uint64(k))


def word_hashes(text: bytes, table: Hashes) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))


def sorted_groups(batches: Iterator, key: str) -> Iterator[list[dict]]:
    """The rows of each key, from batches in which a key's rows follow one another."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != last:
                yield held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield held


#: Ids that are broadcast to leave their rows out; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def picked(rows: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """The rows whose id is (left_semi) or is not (left_anti) among `ids`, a written table; few ids are broadcast, so that rows are not shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, how)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
