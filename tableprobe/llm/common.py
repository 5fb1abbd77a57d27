"""Session settings, saved steps and byte-level hashing shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tableprobe.session import configure, scratch_dir

#: Rows go to Python in batches of at most this many rows and bytes, whatever their length.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"

#: The bytes of `[\x20\x09-\x0D]`, which separate words.
SPACES = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Polynomial hashing modulo 2**64 over random images of the bytes.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_IMAGE = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the settings of the library, small Arrow batches, and no shuffle files of queries that ended."""
    configure(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def saved(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: no lineage, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(step):
    """A step on Arrow batches that keeps no freed memory: workers outlive their tasks, and an executor pays for all of them."""

    @functools.wraps(step)
    def run(*batches):
        try:
            yield from step(*batches)
        finally:
            release()

    return run


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, _UNBASE)):
            row = np.full(max(n + 1, 1 << 16), base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def pieces(column: pa.Array, size: int = 1 << 20):
    """A text column in slices of whole rows of some `size` bytes, or one row: (first row, slice)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


class Spans:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        power, self._unpower = _powers(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_IMAGE[data] * power[:-1], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end], equal for equal bytes of equal length."""
        return mix((self._sums[end] - self._sums[start]) * self._unpower[start] + (end - start).astype(np.uint64))

    def windows(self, size: int, first: int, last: int) -> np.ndarray:
        """The hashes of data[i:i + size] for first <= i < last."""
        raw = (self._sums[first + size : last + size] - self._sums[first:last]) * self._unpower[first:last]
        return mix(raw + np.uint64(size))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a text column as 64-bit hashes, with the first word of every row."""

    def __init__(self, column: pa.Array, lower: bool = True):
        raw, offsets = buffers(column)
        rows = len(offsets) - 1
        # one separator after each row keeps words apart
        place = offsets[:-1] + np.arange(rows)
        data = np.full(len(raw) + rows, 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[offsets[1:] + np.arange(rows)] = False
        data[keep] = _LOWER[raw] if lower else raw
        space = np.ones(len(data) + 1, bool)
        space[1:] = _IS_SPACE[data]
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = turn[0::2], turn[1::2]
        self._spans = Spans(data)
        self.hashes = self._spans.hash(self.starts, self.ends)
        #: words of row i are first[i] to first[i + 1]
        self.first = np.append(np.searchsorted(self.starts, place), len(self.starts))

    def affixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and of the last `size` bytes of every word."""
        ends, starts = np.minimum(self.starts + size, self.ends), np.maximum(self.ends - size, self.starts)
        return self._spans.hash(self.starts, ends), self._spans.hash(starts, self.ends)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` words; with fewer words, of the whole sequence; without words, none."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    count = max(1, len(hashes) - size + 1)
    length = min(size, len(hashes))
    total = np.full(count, length, np.uint64)
    for j in range(length):
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + count])
    return total
