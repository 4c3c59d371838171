"""What the operators share: stages in shared storage, byte buffers, hashes."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.staging import discard, materialize as stage  # noqa: F401
from quarryline.sources.tables import read_table  # noqa: F401

U64 = np.uint64
#: Bytes of text that one round of array operations takes; bounds a worker's memory.
CHUNK = 1 << 19


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files that nothing refers to any more. Only disk depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is written inside sends at most ``rows`` wide rows to a worker at a time; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def doc_key() -> list[Column]:
    """Two columns that identify a document's row, repeated rows alike; null ids included."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k1"),
        F.xxhash64("text").alias("k2"),
    ]


def to_bytes(column: pa.Array) -> pa.LargeBinaryArray:
    """UTF-8 of a string column; null gives empty bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"")


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of whole texts of about ``limit`` bytes.

    A text longer than the limit is a run by itself.
    """
    binary = to_bytes(column)
    n = len(binary)
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class WordHasher:
    """64-bit hashes of byte ranges by a polynomial with a random value per byte."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = (int(rng.integers(1 << 40, 1 << 62)) << 3 | 5) & ((1 << 64) - 1)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        def table(base: int) -> np.ndarray:
            out = np.full(n, base, U64)
            out[0] = 1
            with np.errstate(over="ignore"):
                return np.multiply.accumulate(out)

        if len(self.powers) < n:
            n = max(n, CHUNK + 1)
            self.powers, self.inverses = table(self.base), table(self.inverse)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U64)
            np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U64))


def word_bounds(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True in ``keep``, cut at text borders: starts, ends, and words before each text."""
    n = len(keep)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = keep
    after = np.zeros(n + 1, bool)
    after[:n] = keep
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values the position of its leftmost minimum, by doubling."""
    n = len(values)
    at = np.arange(n)
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: n - size - step + 1], at[step : n - size + 1]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at
