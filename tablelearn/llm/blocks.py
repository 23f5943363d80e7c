"""Texts as numbers of words, in blocks of documents that carry a dictionary of their own.

A block's dictionary is as large as the block makes it, whatever the corpus holds, so that what
is known of words in the whole corpus can be joined to the dictionaries instead of being broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.llm.common import chunks

# Words after which a block is closed; a block holds whole documents.
BLOCK_TOKENS = 2_000_000
# Open blocks of a task may hold so many words together.
OPEN_TOKENS = 2 * BLOCK_TOKENS
# Numbers are gathered so many at a time before they are counted.
_COUNT_AT = 1 << 17


def pack(ids: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which files and shuffles then compress well."""
    return np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def pack_numbers(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane; planes of sorted or small numbers take next to no room in a shuffle."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


class _Block:
    def __init__(self, number: int, mark: bytes):
        self.number, self.tokens = number, 0
        self.places: defaultdict[bytes, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.places[mark]  # noqa: B018 - the mark is number 0
        self.counts, self.waiting, self.held = np.zeros(0, dtype=np.int64), [], 0

    def add(self, words: list[bytes], counted: bool) -> bytes:
        ids = np.fromiter(map(self.places.__getitem__, words), dtype=np.int32, count=len(words))
        self.tokens += len(ids)
        if counted:
            self.waiting.append(ids)
            self.held += len(ids)
            if self.held >= _COUNT_AT:
                self._count()
        return pack(ids)

    def _count(self) -> None:
        found = np.bincount(np.concatenate([np.zeros(0, np.int32), *self.waiting]), minlength=len(self.counts))
        found[: len(self.counts)] += self.counts
        self.counts, self.waiting, self.held = found.astype(np.int64), [], 0

    def dictionary(self) -> tuple[pa.Array, np.ndarray]:
        """Words in the order of their numbers, and how often each was counted."""
        self._count()
        n = np.zeros(len(self.places), dtype=np.int64)
        n[: len(self.counts)] = self.counts
        return pa.array(list(self.places), pa.binary()).cast(pa.string()), n


def encode_blocks(
    rows: DataFrame,
    split: Callable[[bytes], list[bytes]],
    mark: bytes,
    kept: Sequence[str],
    by: str | None = None,
    counted: str | None = None,
    tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Two kinds of rows: ``block, <kept>, ids`` for every row, ``block, word, place, n`` for every word of a block.

    ``split`` makes words of the bytes of a ``text`` (a null one is empty); ``mark`` is number 0 of every block.
    Rows that differ in ``by`` (one of ``kept``, and filled for words too) have separate blocks; ``n`` counts the words of rows where
    ``counted`` is true, or of all. Block numbers are unique within a run; write the result once before using it.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in kept}
    schema = ", ".join(["block long", *[f"`{c}` {k}" for c, k in kinds.items()], "ids binary", "word string, place int, n long"])

    def words_of(block: _Block, group, types: dict[str, pa.DataType]) -> pa.RecordBatch:
        words, n = block.dictionary()
        size = len(words)
        rest = [pa.array([group] * size, types[c]) if c == by else pa.nulls(size, types[c]) for c in kept]
        return pa.record_batch(
            [
                pa.array(np.full(size, block.number)),
                *rest,
                pa.nulls(size, pa.binary()),
                words,
                pa.array(np.arange(size, dtype=np.int32)),
                pa.array(n),
            ],
            names=["block", *kept, "ids", "word", "place", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        open_blocks: dict = {}
        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = {c: batch.schema.field(c).type for c in kept}
            for part in chunks(batch):
                groups = part.column(by).to_pylist() if by else [None] * part.num_rows
                counts = part.column(counted).to_pylist() if counted else [True] * part.num_rows
                numbers, ids, closed = [], [], []
                for group, counting, data in zip(groups, counts, part.column("__text").to_pylist()):
                    block = open_blocks.get(group)
                    if block is None:
                        block = open_blocks[group] = _Block(first, mark)
                        first += 1
                    numbers.append(block.number)
                    ids.append(block.add(split(data or b""), bool(counting)))
                    if block.tokens >= tokens:
                        closed.append((open_blocks.pop(group), group))
                n = part.num_rows
                yield pa.record_batch(
                    [
                        pa.array(numbers, pa.int64()),
                        *[part.column(c) for c in kept],
                        pa.array(ids, pa.binary()),
                        pa.nulls(n, pa.string()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.int64()),
                    ],
                    names=["block", *kept, "ids", "word", "place", "n"],
                )
                if sum(b.tokens for b in open_blocks.values()) >= max(OPEN_TOKENS, tokens):
                    closed += [(b, g) for g, b in open_blocks.items()]
                    open_blocks = {}
                for block, group in closed:
                    yield words_of(block, group, types)
        for group, block in open_blocks.items():
            yield words_of(block, group, types)

    wanted = dict.fromkeys([*kept, *([counted] if counted else [])])
    return rows.select(*[quoted(c) for c in wanted], F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)
