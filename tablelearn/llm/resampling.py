"""Importance resampling towards a target: hashed n-gram features, weights and a seeded draw without replacement."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.functions.ordering import global_rank
from tablelearn.llm.common import chunks
from tablelearn.session import store

BUCKETS = 10_000
SEED = 7
# Only documents of so many words are drawn, and of these so many per cent.
LEAST_WORDS = 20
PERCENT = 25

# Letters A-Z become small; digits, letters and all bytes beyond ASCII are words, the rest separates them.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Shifts:
    """CRC-32 as it is after so many zero bytes, for arrays of CRCs.

    The step over a zero byte is linear over GF(2), so a step over any number of
    bytes is a 32 x 32 bit matrix. Each is held as four tables of 256 entries, one per byte of the CRC:
    one for every length below ``DIRECT`` and one for every power of two from there on.
    """

    DIRECT = 64

    def __init__(self):
        bits = np.array([1 << k for k in range(32)], dtype=np.uint32)
        # The image of each single bit after one zero byte, from CRCs of a zero byte.
        none = crc32(b"\0", 0)
        step = np.array([crc32(b"\0", int(b)) ^ none for b in bits], dtype=np.uint32)
        columns, small = bits.copy(), []
        for _ in range(self.DIRECT):
            small.append(self._tables(columns))
            columns = self._image(self._tables(step), columns)
        self.small = np.stack(small)
        self.powers: list[np.ndarray] = []
        # 32 powers reach far beyond the longest text.
        for _ in range(32):
            self.powers.append(self._tables(columns))
            columns = self._image(self.powers[-1], columns)

    @staticmethod
    def _tables(columns: np.ndarray) -> np.ndarray:
        tables = np.zeros((4, 256), dtype=np.uint32)
        for bit in range(32):
            has = (np.arange(256) >> (bit % 8)) & 1 == 1
            tables[bit // 8, has] ^= columns[bit]
        return tables

    @staticmethod
    def _image(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = tables[0][values & np.uint32(255)]
        for k in (1, 2, 3):
            out = out ^ tables[k][(values >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def over(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each value after as many zero bytes as its length says."""
        low = lengths % self.DIRECT
        out = self.small[low, 0, values & np.uint32(255)]
        for k in (1, 2, 3):
            out ^= self.small[low, k, (values >> np.uint32(8 * k)) & np.uint32(255)]
        high = lengths // self.DIRECT
        bit = 0
        while len(high) and (high >> bit).any():
            far = np.flatnonzero((high >> bit) & 1)
            out[far] = self._image(self.powers[bit], out[far])
            bit += 1
        return out


def _text_features(data: bytes, longest: int, shifts: Shifts) -> tuple[int, list[np.ndarray]]:
    """Words, and CRCs of all runs of 1 to ``longest`` words, run length by run length, from one scan."""
    words = data.translate(_NORMAL).split()
    if not words:
        return 0, []
    # The running CRC at every word's end; the blank before a word is taken with it.
    pieces = [words[0], *[b" " + w for w in words[1:]]]
    ends = np.fromiter(accumulate(pieces, lambda c, p: crc32(p, c), initial=0), dtype=np.uint32, count=len(words) + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    # The running CRC at every word's start is the one at the end before it, one blank further.
    blank = _BYTE_STEP[(~ends[1:-1] ^ np.uint32(32)) & np.uint32(255)] ^ (~ends[1:-1] >> np.uint32(8))
    starts = np.concatenate([ends[:1], ~blank])
    upto = np.cumsum(lengths + 1)
    first = upto - lengths - 1
    out = []
    for n in range(1, min(longest, len(words)) + 1):
        # What lies before the run is shifted over the run and cancelled.
        size = upto[n - 1 :] - 1 - first[: len(words) - n + 1]
        out.append(ends[n:] ^ shifts.over(starts[: len(words) - n + 1], size))
    return len(words), out


# The table of the step over one byte, read off CRCs of single bytes from the state that is all zero.
_BYTE_STEP = np.array([~np.uint32(crc32(bytes([b]), 0xFFFFFFFF)) for b in range(256)], dtype=np.uint32)


def features(docs: DataFrame, longest: int = 2, buckets: int = BUCKETS, key: str | None = "doc_id") -> DataFrame:
    """``doc_id, n_words, buckets``: the buckets of all runs of 1 to ``longest`` words of each whole text.

    A run's bucket is the CRC-32 of its words, joined by one blank, modulo ``buckets``; they are
    held as unsigned 32-bit numbers (16-bit ones where that is enough) in a binary column. A null text has none.
    """
    kind = docs.schema[key].dataType.simpleString() if key else "long"
    narrow = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for batch in batches:
            for part in chunks(batch):
                counts, found = [], []
                for data in part.column("text").to_pylist():
                    n, crcs = _text_features(data or b"", longest, shifts)
                    counts.append(n)
                    every = np.concatenate(crcs) if crcs else np.zeros(0, dtype=np.uint32)
                    found.append((every % np.uint32(buckets)).astype(narrow).tobytes())
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.binary())],
                    names=["doc_id", "n_words", "buckets"],
                )

    chosen = docs.select(
        (quoted(key) if key else F.lit(None).cast("long")).alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    return chosen.mapInArrow(run, f"doc_id {kind}, n_words long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all documents: summed in the tasks, then by bucket; one number per bucket
    reaches the driver, and ``buckets`` is their bound."""
    narrow = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch):
                joined = b"".join(part.column("buckets").to_pylist())
                total += np.bincount(np.frombuffer(joined, dtype=narrow), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows, out = counted.toArrow(), np.zeros(buckets, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the raw documents, floored."""
    n = len(raw)
    ratio = (target + 1.0) * (raw.sum() + float(n)) / ((raw + 1.0) * (target.sum() + float(n)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains of a document's features, 0 without any."""
    narrow = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sums, sizes = [], []
                for data in part.column("buckets").to_pylist():
                    own = np.frombuffer(data, dtype=narrow)
                    sums.append(int(gains[own].sum()))
                    sizes.append(len(own))
                sums, sizes = np.array(sums, dtype=np.int64), np.array(sizes, dtype=np.int64)
                weight = np.floor_divide(sums, np.maximum(sizes, 1))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("n_words"), pa.array(sizes), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(key: str = "doc_id", seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that depends on the key alone, floored; a null key draws as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 2,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Texts of ``docs`` and ``target`` are scanned once; the buckets of the former are stored and read for the
    counts and the weights. Of the N rows with at least ``least_words`` words the ``percent`` * N // 100
    with the highest scores (weight plus a Gumbel draw) are drawn and numbered by score, ties to the smaller doc_id;
    others have a null rank. Null texts have no features and weight 0. Null ids draw alike and come after
    all others among ties; rows of one id are rows like others. Empty tables give no rows or no target features.
    Other columns are not read.
    """
    found = store(features(docs, longest, buckets), "features")
    gains = bucket_gains(
        bucket_counts(found, buckets), bucket_counts(features(target, longest, buckets, key=None), buckets)
    )
    scored = weigh(found, gains).withColumn("score", F.col("weight") + gumbel(seed=seed))
    scored = store(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = enough.withColumn("falling", -F.col("score")).withColumn("without_id", F.col("doc_id").isNull())
    ranked = global_rank(order, ["falling", "without_id", "doc_id", "row"])
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    )
