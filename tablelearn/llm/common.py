"""Words, hashes and Arrow batches shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows of a batch that are turned into Python objects at a time.
CHUNK_ROWS = 256
# A word is a run of anything but the space and the characters 9 to 13.
BLANKS = b" \t\n\x0b\x0c\r"

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS)] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(batch: pa.RecordBatch, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all of them (splitmix)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_POWERS = np.array([pow(int(_MULTIPLIER), k, 1 << 64) for k in range(4096)], dtype=np.uint64)


def _power(exponents: np.ndarray) -> np.ndarray:
    """Powers of the multiplier; those beyond the table come from its period of 4096."""
    if len(exponents) and exponents.max() >= len(_POWERS):
        high, low = np.divmod(exponents, len(_POWERS))
        step = pow(int(_MULTIPLIER), len(_POWERS), 1 << 64)
        table = [1]
        for _ in range(int(high.max())):
            table.append(table[-1] * step & ((1 << 64) - 1))
        return np.array(table, dtype=np.uint64)[high] * _POWERS[low]
    return _POWERS[exponents]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of UTF-8 data."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_BLANK[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, without a Python object for any of them."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        lengths = ends - starts
        total = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        inner = np.arange(total) - np.repeat(first, lengths)
        values = _BYTE_VALUES[data[np.repeat(starts, lengths) + inner]] * _power(inner)
        return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` values."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    count = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        out = np.zeros(count, dtype=np.uint64)
        for k in range(size):
            out = out * _MULTIPLIER + hashes[k : k + count]
        return mixed(out)


def as_signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
