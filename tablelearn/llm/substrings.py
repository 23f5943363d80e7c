"""Removal of word passages that occur earlier in the corpus, by suffix automata of reference shards.

Comparing every document with every reference would grow with the square of the
corpus. So the reference is cut by content: every window of WINDOW words has an
anchor, its run of ANCHOR words with the smallest hash; equal windows have equal
anchors. Consecutive windows with one anchor occurrence form a segment.

1. Segments whose anchor occurs once in the corpus cannot repeat; the others stay.
2. Of segments with equal content only the first keeps its windows; the others are
   covered by it whole.
3. The distinct contents of an anchor may still share windows. They are the references:
   shards of them, cut by anchor and bounded in size, become suffix automata whose
   states know where they first occurred, and the segments of the shard are streamed
   through for matching statistics. A match of WINDOW words that occurs earlier is
   removed. An anchor with very many contents is resolved by its windows instead:
   the first place of each distinct window is an aggregate.
4. What was found goes back to the documents, which lose all words so covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablelearn.llm.common import chunks, mixed, window_hashes, word_hashes, word_spans
from tablelearn.llm.groups import by_cell
from tablelearn.session import store

WINDOW = 20
ANCHOR = 5
# Segments of a reference shard, about, and contents from which an anchor is resolved by its windows.
SHARD_SEGMENTS = 2_000
MANY_CONTENTS = 2_000
# A null doc_id stands before all others, as one document.
NO_ID = -(1 << 63)

# Places pack the start of a segment's first window and its number of windows.
_WINDOWS_BITS = 5

_PLUS, _FIRST, _EARLIER, _SOURCE = range(4)


def words_of(text: bytes) -> list[bytes]:
    return text.split()


def segments(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, document, start, windows) of the segments of documents laid end to end."""
    empty = np.zeros(0, dtype=np.int64)
    total = len(hashes) - WINDOW + 1
    begin = np.cumsum(sizes) - sizes
    if total <= 0:
        return empty, empty, empty, empty, empty
    owner = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(owner[:total] == owner[WINDOW - 1 :])
    if not len(valid):
        return empty, empty, empty, empty, empty
    anchors = window_hashes(hashes, ANCHOR)
    least, place = anchors[:total].copy(), np.zeros(total, dtype=np.int8)
    for k in range(1, WINDOW - ANCHOR + 1):
        smaller = anchors[k : k + total] < least
        least[smaller] = anchors[k : k + total][smaller]
        place[smaller] = k
    at = valid + place[valid]
    fresh = np.ones(len(valid), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(valid)))
    with np.errstate(over="ignore"):
        inner = (np.arange(len(valid)) - np.repeat(first, count)).astype(np.uint64)
        windows = window_hashes(hashes, WINDOW)[valid]
        content = np.add.reduceat(mixed(windows + inner * np.uint64(0x9E3779B97F4A7C15)), first)
    doc = owner[valid[first]]
    return least[valid[first]].view(np.int64), content.view(np.int64), doc, valid[first] - begin[doc], count


def find_segments(docs: DataFrame) -> DataFrame:
    """anchor, content, did, tid, place of every segment of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, sizes = [], []
                for text in part.column("text").to_pylist():
                    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                    hashes.append(word_hashes(data, *word_spans(data)))
                    sizes.append(len(hashes[-1]))
                anchor, content, doc, start, count = segments(np.concatenate(hashes), np.array(sizes))
                did, tid = (part.column(c).to_numpy()[doc] for c in ("did", "tid"))
                place = (start << _WINDOWS_BITS) | count
                yield pa.record_batch(
                    [pa.array(x.astype(np.int64)) for x in (anchor, content, did, tid, place)],
                    names=["anchor", "content", "did", "tid", "place"],
                )

    schema = "anchor long, content long, did long, tid long, place long"
    return docs.select("did", "tid", "text").mapInArrow(run, schema)


class SuffixAutomaton:
    """Suffixes of several word sequences; every state knows the first place where it ended.

    Sequences must be added in the order of their places.
    """

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]
        self.places: list[tuple] = []

    def add(self, words: list[bytes], did, start: int) -> None:
        last = 0
        for i, word in enumerate(words):
            self.places.append((did, start + i))
            last = self._extend(last, word, len(self.places) - 1)

    def _state(self, length: int, moves: dict[bytes, int], link: int, first: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.link) - 1

    def _extend(self, last: int, word: bytes, place: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0, place)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes], least: int) -> Iterator[tuple[int, tuple | None]]:
        """Matching statistics, word by word: the length up to ``least`` of the longest suffix read that
        occurs in the references, and, if it has that length, the place where it first ended."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            while state and self.length[self.link[state]] >= least:
                state = self.link[state]
            length = min(length, least)
            yield length, self.places[self.first[state]] if length == least else None


def earlier_windows(rows: list[tuple]) -> list[tuple]:
    """(did, start) of the windows of these (did, start, words) that occur earlier among them.

    Documents may be named by anything that has an order.
    """
    automaton = SuffixAutomaton()
    rows = sorted(rows, key=lambda r: r[:2])
    for did, start, words in rows:
        automaton.add(words, did, start)
    found = []
    for did, start, words in rows:
        for i, (_, place) in enumerate(automaton.matches(words, WINDOW)):
            if place is not None and place < (did, start + i):
                found.append((did, start + i - WINDOW + 1))
    return found


def _stream_shard(shard: pa.Table) -> pa.RecordBatch | None:
    rows = [
        ((did, tid), place >> _WINDOWS_BITS, words_of(words))
        for did, tid, place, words in zip(*(shard[c].to_pylist() for c in ("did", "tid", "place", "words")))
    ]
    found = earlier_windows(rows)
    if not found:
        return None
    did, tid, place = zip(*((*doc, start << _WINDOWS_BITS | 1) for doc, start in found))
    return pa.record_batch([pa.array(x, pa.int64()) for x in (did, tid, place)], names=["did", "tid", "place"])


def _packed(docs: DataFrame) -> DataFrame:
    """did, tid, packed: texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks(batch):
                out = [press.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                columns = [part.column("did"), part.column("tid"), pa.array(out, pa.binary())]
                yield pa.record_batch(columns, names=["did", "tid", "packed"])

    return docs.select("did", "tid", "text").mapInArrow(run, "did long, tid long, packed binary")


def _references(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """cell, did, tid, place, words of the wanted segments; those of crowded anchors as windows without a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in chunks(batch):
                rows: list[tuple] = []
                columns = (part.column(c).to_pylist() for c in ("did", "tid", "packed", "wants"))
                for did, tid, packed, wants in zip(*columns):
                    words = words_of(unpress.decompress(packed))
                    for want in wants:
                        start, count = want["place"] >> _WINDOWS_BITS, want["place"] & ((1 << _WINDOWS_BITS) - 1)
                        if want["cell"] is not None:
                            passage = b" ".join(words[start : start + count + WINDOW - 1])
                            rows.append((want["cell"], did, tid, want["place"], passage))
                            continue
                        for at in range(start, start + count):
                            rows.append((None, did, tid, at << _WINDOWS_BITS | 1, b" ".join(words[at : at + WINDOW])))
                cell, did, tid, place, words = zip(*rows) if rows else ((), (), (), (), ())
                yield pa.record_batch(
                    [*(pa.array(x, pa.int64()) for x in (cell, did, tid, place)), pa.array(words, pa.binary())],
                    names=["cell", "did", "tid", "place", "words"],
                )

    wants = wanted.groupBy("did", "tid").agg(F.collect_list(F.struct("place", "cell")).alias("wants"))
    return packed.join(wants, ["did", "tid"]).mapInArrow(run, "cell long, did long, tid long, place long, words binary")


def _remove(packed: DataFrame, marks: DataFrame) -> DataFrame:
    """did, n_words, n_removed, kept (the words that stay, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in chunks(batch):
                sizes, removed, kept = [], [], []
                for packed, found in zip(part.column("packed").to_pylist(), part.column("marks").to_pylist()):
                    words = words_of(unpress.decompress(packed))
                    gone = covered(len(words), found or ())
                    sizes.append(len(words))
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words))
                yield pa.record_batch(
                    [
                        part.column("did"),
                        pa.array(sizes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["did", "n_words", "n_removed", "kept"],
                )

    joined = packed.join(marks, ["did", "tid"], "left")
    return joined.mapInArrow(run, "did long, n_words long, n_removed long, kept string")


def covered(size: int, marks: list[int]) -> np.ndarray:
    """Which of a document's words are in a window to be removed.

    Marks hold kind and place. In the order of the kinds: repeated segments are to
    go, those that are the first of their content stay, windows of these that occur
    earlier go, and windows that are the first of all stay.
    """
    windows = np.zeros(max(size - WINDOW + 1, 0), dtype=bool)
    places = np.array(marks, dtype=np.int64)
    for kind in range(4):
        own = places[places & 3 == kind] >> 2
        for start, count in zip((own >> _WINDOWS_BITS).tolist(), (own & ((1 << _WINDOWS_BITS) - 1)).tolist()):
            windows[start : start + count] = kind in (_PLUS, _EARLIER)
    words = np.zeros(size + 1, dtype=np.int32)
    at = np.flatnonzero(windows)
    np.add.at(words, at, 1)
    np.add.at(words, at + WINDOW, -1)
    return np.cumsum(words[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every document without the passages that occur earlier.

    A word goes if a run of WINDOW words that covers it also starts earlier: in a
    document with a smaller doc_id, or before in the same one. Runs are judged on
    the input. ``kept`` holds the other words, unchanged, joined by one space.
    A null or empty text has no words. Null ids come before all others. Rows with
    different texts are different documents also if they share a doc_id (of type long
    or int) or have none; they are ordered by a hash of the text. Rows that repeat
    doc_id and text are one document that has each of its places more than once; a run
    at the same place in all of them is no repeat.
    """
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("tid"), "text"
    )
    found = find_segments(named)
    # Written, so that the join that follows has two plain shuffles, of which Spark splits large partitions.
    repeated = store(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    occurrences = store(found.join(repeated, "anchor", "left_semi"), "occurrences")
    firsts = store(
        occurrences.groupBy("anchor", "content")
        .agg(F.min(F.struct("did", "tid", "place")).alias("first"))
        .select("anchor", "first.did", "first.tid", "first.place"),
        "firsts",
    )
    shared = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    shards = max(1, -(-firsts.count() // SHARD_SEGMENTS))
    cell = F.when(F.col("contents") < MANY_CONTENTS, F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    wanted = firsts.join(shared, "anchor").select("did", "tid", "place", cell.alias("cell"))
    packed = _packed(named)
    references = store(_references(packed, wanted), "references")
    earlier = by_cell(references.where("cell is not null"), _stream_shard, "did long, tid long, place long")
    windows = references.where("cell is null")
    sources = windows.groupBy("words").agg(F.min(F.struct("did", "tid", "place")).alias("first")).select("first.*")
    marks = [(occurrences, _PLUS), (firsts, _FIRST), (earlier, _EARLIER), (windows, _EARLIER), (sources, _SOURCE)]
    marked = None
    for rows, kind in marks:
        part = rows.select("did", "tid", (F.shiftleft("place", 2) + kind).alias("mark"))
        marked = part if marked is None else marked.union(part)
    # A set, since rows that repeat a document bring the same marks.
    removed = _remove(packed, marked.groupBy("did", "tid").agg(F.collect_set("mark").alias("marks")))
    return removed.select(
        F.when(F.col("did") != NO_ID, F.col("did")).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_words",
        "n_removed",
        "kept",
    )
