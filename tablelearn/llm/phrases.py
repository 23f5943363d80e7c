"""Collocations: phrases whose words occur together far more often than their parts suggest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelearn.functions.ordering import global_rank
from tablelearn.llm.blocks import encode_blocks, pack_numbers, unpack, unpack_numbers
from tablelearn.llm.common import mixed
from tablelearn.session import fit_table, store

# Least occurrences of a phrase, the per cent of them inside one longer phrase that drop it, and the phrases returned.
LEAST = 10
INSIDE = 50
TOP = 2_000
UNDETERMINED = "und"

# Entries of a container before it bursts into one per next word, and of a trie before subtrees are spilled.
BURST = 4_096
SPILL = 400_000
# Words of a stream that are counted at a time.
STREAM = 1 << 18

_BREAKS = b".,;:!?\n\x0b\x0c\r"
# A-Z become small, separators of pieces a line feed, the tab a blank.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _BREAKS else 32 if c == 9 else c for c in range(256))


def split_pieces(data: bytes) -> list[bytes]:
    """Lower-cased words in order, with a line feed wherever a piece ends; no word holds a line feed."""
    return [w for w in data.translate(_NORMAL).replace(b"\n", b" \n ").split(b" ") if w]


class HatTrie:
    """Counts of runs of two or three word numbers.

    The first word leads to a container, a hash table of the rest; a container that outgrows
    ``burst`` becomes a node with one container per second word. When the trie holds more than ``spill`` entries,
    its largest subtrees leave it as sorted runs until half is left.
    """

    def __init__(self, width: int, burst: int = BURST, spill: int = SPILL):
        self.width, self.burst, self.spill = width, burst, spill
        self.whole: dict[int, dict[int, int]] = {}
        self.nodes: dict[int, dict[int, dict[int, int]]] = {}
        self.sizes: dict[int, int] = {}
        self.entries = 0

    def add(self, first: int, rests: list[int], counts: list[int]) -> None:
        """Add runs that begin with ``first``; a rest is second * width + third, third 0 for runs of two."""
        node = self.nodes.get(first)
        before = self.sizes.get(first, 0)
        if node is None:
            held = self.whole.setdefault(first, {})
            for rest, n in zip(rests, counts):
                held[rest] = held.get(rest, 0) + n
            after = len(held)
            if after > self.burst:
                self._burst(first)
        else:
            after = before
            for rest, n in zip(rests, counts):
                second, third = divmod(rest, self.width)
                held = node.setdefault(second, {})
                after += third not in held
                held[third] = held.get(third, 0) + n
        self.sizes[first] = after
        self.entries += after - before

    def _burst(self, first: int) -> None:
        node: dict[int, dict[int, int]] = {}
        for rest, n in self.whole.pop(first).items():
            second, third = divmod(rest, self.width)
            node.setdefault(second, {})[third] = n
        self.nodes[first] = node

    def _run(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Rests and counts of a subtree, sorted; the subtree is gone afterwards."""
        self.entries -= self.sizes.pop(first)
        if first in self.whole:
            held = self.whole.pop(first)
            rests = np.fromiter(held, dtype=np.int64, count=len(held))
            counts = np.fromiter(held.values(), dtype=np.int64, count=len(held))
        else:
            node = self.nodes.pop(first)
            rests = np.concatenate(
                [np.fromiter(held, dtype=np.int64, count=len(held)) + second * self.width for second, held in node.items()]
            )
            counts = np.concatenate(
                [np.fromiter(held.values(), dtype=np.int64, count=len(held)) for held in node.values()]
            )
        order = np.argsort(rests)
        return rests[order], counts[order]

    def runs(self, upto: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First words, rests and counts of whole subtrees, the largest first, until at most ``upto`` entries are left."""
        waiting, size = [], 0
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= upto and upto:
                break
            rests, counts = self._run(first)
            waiting.append((np.full(len(rests), first, dtype=np.int64), rests, counts))
            size += len(rests)
            if size >= 1 << 16:
                yield tuple(map(np.concatenate, zip(*waiting)))
                waiting, size = [], 0
        if waiting:
            yield tuple(map(np.concatenate, zip(*waiting)))

    def full(self) -> bool:
        return self.entries > self.spill


def _distinct(first: np.ndarray, rest: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    if width**3 < 1 << 62:
        keys, counts = np.unique(first * (width * width) + rest, return_counts=True)
        first, rest = np.divmod(keys, width * width)
        return first, rest, counts
    order = np.lexsort((rest, first))
    first, rest = first[order], rest[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
    starts = np.flatnonzero(new)
    return first[starts], rest[starts], np.diff(np.append(starts, len(first)))


def count_stream(trie: HatTrie, stream: np.ndarray) -> None:
    """Add all runs of two and three numbers of a stream to the trie; 0 is in no run."""
    a = stream.astype(np.int64)
    two = (a[:-1] > 0) & (a[1:] > 0) if len(a) > 1 else np.zeros(0, dtype=bool)
    at = np.flatnonzero(two)
    at3 = np.flatnonzero(two[:-1] & two[1:]) if len(two) > 1 else at[:0]
    if not len(at):
        return
    firsts = np.concatenate([a[at], a[at3]])
    rests = np.concatenate([a[at + 1] * trie.width, a[at3 + 1] * trie.width + a[at3 + 2]])
    firsts, rests, counts = _distinct(firsts, rests, trie.width)
    cuts = np.flatnonzero(np.diff(firsts)) + 1
    starts = np.concatenate([[0], cuts]).tolist()
    ends = np.concatenate([cuts, [len(firsts)]]).tolist()
    heads, rests, counts = firsts[starts].tolist(), rests.tolist(), counts.tolist()
    for head, start, end in zip(heads, starts, ends):
        trie.add(head, rests[start:end], counts[start:end])


_WORD_COLUMNS = ("first", "second", "third", "n")


def _count_blocks(parts: int):
    """Runs of the frequent words of each block (whose words come before its texts), as sorted parts: every
    run goes to the part that its first two words choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, trie, names, numbers = None, None, None, None
        known: list[pa.RecordBatch] = []
        stream: list[np.ndarray] = []
        size = 0

        def rows(runs) -> Iterator[pa.RecordBatch]:
            for first, rest, n in runs:
                second, third = np.divmod(rest, trie.width)
                words = [names[first], names[second], np.where(third > 0, names[third], 0), n]
                part = (mixed((words[0] * 0x9E3779B1 + words[1]).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((words[2], words[1], words[0], part))
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                pieces = [np.split(w[order], cuts) for w in words]
                yield pa.record_batch(
                    [
                        pa.array(part[order][np.concatenate([[0], cuts]).astype(np.int64)]),
                        *[pa.array([pack_numbers(v) for v in piece], pa.binary()) for piece in pieces],
                    ],
                    names=["part", *_WORD_COLUMNS],
                )

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal size
            count_stream(trie, np.concatenate(stream))
            stream.clear()
            size = 0
            if trie.full():
                yield from rows(trie.runs(trie.spill // 2))

        def closed() -> Iterator[pa.RecordBatch]:
            if trie is not None:
                if stream:
                    yield from counted()
                yield from rows(trie.runs())

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            is_word = np.asarray(batch.column("place").is_valid())
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(is_word.astype(np.int8)) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if blocks[start] != block:
                    yield from closed()
                    block, trie, known, stream, size = blocks[start], None, [], [], 0
                if is_word[start]:
                    known.append(part.select(["place", "gid"]))
                    continue
                if not known:
                    continue
                if trie is None:
                    table = pa.Table.from_batches(known)
                    places = table["place"].to_numpy()
                    # Number 0 is no word; the others follow the places.
                    names = np.concatenate([[0], table["gid"].to_numpy()])
                    numbers = np.zeros(places.max() + 1, dtype=np.int64)
                    numbers[places] = np.arange(1, len(places) + 1)
                    trie = HatTrie(len(places) + 1)
                for data in part.column("ids").to_pylist():
                    ids = unpack(data)
                    # Places beyond the last frequent word, and rare words between, are breaks.
                    known_ids = np.where(ids < len(numbers), numbers[np.minimum(ids, len(numbers) - 1)], 0)
                    stream += [known_ids, np.zeros(1, dtype=np.int64)]
                    size += len(ids) + 1
                    if size >= STREAM:
                        yield from counted()
        yield from closed()

    return run


def _merge_part(least: int):
    """Sum the sorted runs of one part; runs of three meet the run of two they begin with there."""

    def run(table: pa.Table) -> pa.Table:
        first, second, third, n = (
            np.concatenate([unpack_numbers(d) for d in table[c].to_pylist()]) for c in _WORD_COLUMNS
        )
        order = np.lexsort((third, second, first))
        first, second, third, n = first[order], second[order], third[order], n[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (third[1:] != third[:-1])
        starts = np.flatnonzero(new)
        total = np.add.reduceat(n, starts)
        starts, total = starts[total >= least], total[total >= least]
        first, second, third = first[starts], second[starts], third[starts]
        longer = np.zeros(len(total), dtype=np.int64)
        if len(total):
            # A frequent run of three has a frequent run of two before it, which sorts first.
            heads = np.flatnonzero(third == 0)
            longer[heads] = np.maximum.reduceat(np.where(third > 0, total, 0), heads)
        return pa.table(
            {
                "first": pa.array(first),
                "second": pa.array(second),
                "third": pa.array(third, mask=third == 0),
                "a": pa.array(total),
                "longer": pa.array(longer),
            }
        )

    return run


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: up to 10^13 occurrences the products fit 38 digits."""
    a, left, right = (x.cast("decimal(13,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


# Occurrences of runs that a part is to hold; there are at least so many parts for each partition of a shuffle.
PART_RUNS, PARTS = 2_000_000, 4


def frequent_runs(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``first, second, third, a, longer`` of the runs of two and three words with at least ``least`` occurrences, as
    numbers of words (third null for two; longer: the most of a run of three that begins with the two);
    ``lang, word, c, gid`` of the frequent words; all word occurrences per language.

    A run is frequent only if its words are, so tries hold frequent words only; words are numbered by frequency, and their
    numbers joined to the dictionaries of the blocks by shuffle. Runs leave a task counted, sorted and packed, dealt
    by their first two words into parts that grow in number with the corpus, and each part is merged by one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), "text")
    blocks = store(encode_blocks(rows, split_pieces, b"\n", ["lang"], by="lang"), "pieces")
    words = blocks.where("place > 0").select("block", "lang", "word", "place", "n")
    counted = words.groupBy("lang", "word").agg(F.sum("n").alias("c"))
    totals = store(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ranked = global_rank(counted.where(F.col("c") >= least).withColumn("rare", -F.col("c")), ["rare", "lang", "word"], "gid")
    vocabulary = store(ranked.drop("rare"), "vocabulary")
    known = words.drop("n").join(vocabulary, ["lang", "word"]).select("block", "place", "gid")
    texts = blocks.where("place is null").select("block", "ids")
    both = known.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions(
        "block", F.col("place").asc_nulls_last()
    )
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * tokens // PART_RUNS)
    packed = ", ".join(f"{c} binary" for c in _WORD_COLUMNS)
    runs = both.select("block", "place", "gid", "ids").mapInArrow(_count_blocks(parts), f"part long, {packed}")
    merged = runs.groupBy("part").applyInArrow(
        _merge_part(least), "first long, second long, third long, a long, longer long"
    )
    return store(merged, "runs"), vocabulary, totals


def mine_phrases(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words of each language.

    A phrase lies within a piece of a whole text; a null text has none, a null language is ``und``, and
    so is a language of that name. Of the cuts of a phrase the one with the lowest score counts, of equal ones the first. A
    phrase goes if one longer candidate holds ``inside`` per cent of its occurrences. Repeated rows count each; ids
    and other columns are not read. A table without such phrases gives no rows.
    """
    found, vocabulary, totals = frequent_runs(docs, least)
    one = vocabulary.select("lang", F.col("gid").alias("first"), F.col("word").alias("w1"), F.col("c").alias("c_first"))
    two = vocabulary.select(F.col("gid").alias("second"), F.col("word").alias("w2"), F.col("c").alias("c_last"))
    pairs = store(found.where("third is null").drop("third").join(one, "first").join(two, "second"), "pairs")
    starts = pairs.select("lang", "first", "second", F.col("a").alias("f_first"), "c_first", "w1", "w2")
    ends = pairs.select(
        F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("f_last"), "c_last", F.col("w2").alias("w3")
    )
    triples = found.where("third is not null").drop("longer")
    covering = triples.groupBy(F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("after"))
    longer = F.greatest("longer", F.coalesce("after", F.lit(0)))
    pairs = (
        pairs.join(covering, ["first", "second"], "left")
        .where(100 * longer < inside * F.col("a"))
        .select(
            "lang",
            F.concat_ws(" ", "w1", "w2").alias("phrase"),
            "a",
            F.col("c_first").alias("l"),
            F.col("c_last").alias("r"),
            _score(F.col("a"), F.col("c_first"), F.col("c_last")).alias("score"),
        )
    )
    early = _score(F.col("a"), F.col("c_first"), F.col("f_last"))
    late = _score(F.col("a"), F.col("f_first"), F.col("c_last"))
    first_cut = F.col("early") <= F.col("late")
    triples = (
        triples.join(starts, ["first", "second"])
        .join(ends, ["second", "third"])
        .withColumn("early", early)
        .withColumn("late", late)
        .select(
            "lang",
            F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
            "a",
            F.when(first_cut, F.col("c_first")).otherwise(F.col("f_first")).alias("l"),
            F.when(first_cut, F.col("f_last")).otherwise(F.col("c_last")).alias("r"),
            F.least("early", "late").alias("score"),
        )
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(fit_table(totals).hinted(), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
