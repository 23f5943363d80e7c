"""A hidden Markov language model: Baum-Welch over blocks of texts, exact log probabilities of whole texts."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.llm.blocks import encode_blocks, pack, pack_numbers, unpack, unpack_numbers
from tablelearn.session import Workspace, store

STATES = 6
ROUNDS = 3
# Each state gives this share of its words by the base distribution, which alone knows unseen words.
BASE_SHARE = 0.3
# Added to every count by the base distribution.
ADDED = 0.1
# Words the training texts hold less often have no counts of their own in the states: they share those of the
# words with the same two last characters, by their frequency. Endings are hashed into so many classes.
RARE, CLASSES = 5, 1024
# Chance to stay in a state before anything is learned; later every transition counts once more than it was seen.
STAY = 0.9
SEED = 13
# Words of texts that are run through the model at a time, which bounds a task's memory for very long texts.
STEP_TOKENS = 1 << 18
# Words of a block: larger blocks hold fewer copies of the frequent words' counts in all.
BLOCK_TOKENS = 4_000_000
# Words with counts of their own are dealt by hash into slices of about this many, and a task that
# serves or sums one slice meets about so many (block, word) pairs; more are dealt over more tasks.
SLICE_WORDS, GROUP_WORDS = 50_000, 4_000_000
# The states' shares of a word's count travel in steps of one 255th.
_STEPS = 255
# Sums over whole blocks are added up in so many groups first.
_SPREAD = 1024

_END = b""


def held_out(key: str = "doc_id") -> Column:
    """True for the tenth of the keys that nothing is learned from; false for a null key."""
    return F.coalesce(F.crc32(quoted(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def words_and_end(data: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end, which is the one empty word."""
    words = data.lower().split()
    words.append(_END)
    return words


# ---------------------------------------------------------------- the model in one task


@dataclass(frozen=True)
class Chain:
    """What all blocks share: ``states`` squared numbers and the sizes of the training corpus."""

    start: np.ndarray
    moves: np.ndarray
    totals: np.ndarray
    tokens: int
    distinct: int
    base_share: float = BASE_SHARE
    class_sums: np.ndarray | None = None
    class_counts: np.ndarray | None = None

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / (self.tokens + ADDED * (self.distinct + 1))

    def emissions(
        self, counts: np.ndarray, sums: np.ndarray, classes: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of words in every state, and the part of each that the state itself has learned."""
        if classes is not None:
            rare = np.flatnonzero((counts > 0) & (counts < RARE))
            share = counts[rare] / self.class_counts[classes[rare]]
            sums = sums.copy()
            sums[rare] = self.class_sums[classes[rare]] * share[:, None]
        own = sums * ((1 - self.base_share) / np.maximum(self.totals, 1e-300))
        emit = np.where(self.totals > 0, self.base_share, 1.0) * self.base(counts)[:, None]
        emit += own
        own /= emit
        return emit, own


class Batch:
    """Texts side by side, the longest first, step by step: all first words, then all second words, ..."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.width = np.bincount(lengths, minlength=lengths.max() + 1)[::-1].cumsum()[::-1][1:]
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        doc = np.repeat(np.arange(len(texts)), lengths)
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = self.at[step] + doc
        self.ids = np.empty(len(doc), dtype=np.int64)
        self.ids[place] = np.concatenate(texts)
        self.doc = np.empty(len(doc), dtype=np.int64)
        self.doc[place] = doc
        self.steps, self.size = len(self.width), len(texts)

    def spans(self) -> list[tuple[int, int]]:
        """Runs of steps with about ``STEP_TOKENS`` words each."""
        marks = np.unique(np.searchsorted(self.at, np.arange(0, self.at[-1], STEP_TOKENS)))
        marks = marks[marks < self.steps]
        return list(zip(marks.tolist(), [*marks[1:].tolist(), self.steps]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.size)


def batches_of(texts: list[np.ndarray], limit: int = STEP_TOKENS) -> Iterator[tuple[list[int], Batch]]:
    """Texts in batches of similar length, each of at most ``limit`` words or one text."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    held, size = [], 0
    for i in order:
        if held and size + len(texts[i]) > limit:
            yield held, Batch([texts[k] for k in held])
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield held, Batch([texts[k] for k in held])


def forward(chain: Chain, batch: Batch, emit: np.ndarray, span: tuple[int, int], entry: np.ndarray | None):
    """Scaled forward vectors of a span of steps and their scales; ``entry`` is the vectors of the step before."""
    first, last = span
    base = batch.at[first]
    out = np.empty((batch.at[last] - base, len(chain.start)), dtype=emit.dtype)
    scales = np.empty(len(out), dtype=emit.dtype)
    steps = chain.moves.astype(emit.dtype)
    now = entry
    for t in range(first, last):
        n, a = batch.width[t], batch.at[t] - base
        here = out[a : a + n]
        if t == 0:
            np.multiply(emit[a : a + n], chain.start, out=here)
        else:
            np.matmul(now[:n], steps, out=here)
            here *= emit[a : a + n]
        sums = here.sum(axis=1)
        scales[a : a + n] = sums
        here /= sums[:, None]
        now = here
    return out, scales


def log_probabilities(chain: Chain, batch: Batch, emit: np.ndarray) -> np.ndarray:
    """Base-10 log probability of every text of the batch."""
    entry, logs = None, np.empty(len(batch.ids))
    for first, last in batch.spans():
        a, b = batch.at[first], batch.at[last]
        vectors, scales = forward(chain, batch, emit[batch.ids[a:b]], (first, last), entry)
        entry = vectors[batch.at[last - 1] - a :].copy()
        logs[a:b] = np.log10(scales)
    return batch.sums(logs)


def expected(chain: Chain, batch: Batch, emit: np.ndarray, words: int):
    """Expected counts of one batch: (words x states), moves (states x states), starts.

    Where a batch has more than one span, only the vectors between spans are kept and a span's
    own are computed again on the way back.
    """
    states = len(chain.start)
    spans, entries = batch.spans(), [None]
    kept = None
    for first, last in spans:
        a, b = batch.at[first], batch.at[last]
        kept = forward(chain, batch, emit[batch.ids[a:b]], (first, last), entries[-1])
        entries.append(kept[0][batch.at[last - 1] - a :].copy())
    seen, moves = np.zeros((words, states)), np.zeros((states, states))
    starts = np.zeros(states)
    ways = np.ascontiguousarray(chain.moves.T.astype(emit.dtype))
    after = None
    for i in range(len(spans) - 1, -1, -1):
        first, last = spans[i]
        a, b = batch.at[first], batch.at[last]
        here = emit[batch.ids[a:b]]
        vectors, scales = kept if i == len(spans) - 1 else forward(chain, batch, here, (first, last), entries[i])
        here /= scales[:, None]
        shares = np.empty_like(vectors)
        for t in range(last - 1, first - 1, -1):
            n, at = batch.width[t], batch.at[t] - a
            back = np.ones((n, states), dtype=emit.dtype)
            if after is not None:
                m = len(after)
                np.matmul(after, ways, out=back[:m])
                moves += vectors[at : at + m].T @ after
            shares[at : at + n] = vectors[at : at + n] * back
            after = here[at : at + n] * back
        if first == 0:
            starts += shares[: batch.width[0]].sum(axis=0)
        for k in range(states):
            seen[:, k] += np.bincount(batch.ids[a:b], weights=shares[:, k], minlength=words)
    return seen, moves * chain.moves, starts


# ---------------------------------------------------------------- the model over all blocks


def _squeeze(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def _gaps(index: np.ndarray) -> bytes:
    return _squeeze(pack(np.diff(index, prepend=0)))


def _index(gaps: bytes) -> np.ndarray:
    return unpack(zlib.decompress(gaps)).cumsum()


def _shares(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares (words x states) in steps; their sum with other shares of the same count is not rescaled."""
    whole = np.rint(_STEPS * sums / np.maximum(counts, 1e-300)[:, None])
    return np.clip(whole, 0, _STEPS).astype(np.uint8)


def _pack_shares(shares: np.ndarray) -> bytes:
    return _squeeze(shares.T.tobytes())


def _unpack_shares(data: bytes, states: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(states, -1).T


def _pack_words(words: pa.Table) -> pa.Table:
    """The words of a block in one slice as one row: first those with counts of their own, by index."""
    place, c, kind = (words[n].to_numpy() for n in ("place", "c", "class"))
    own = np.flatnonzero(c >= RARE)
    index = pc.fill_null(words["index"], 0).to_numpy()[own].astype(np.int64)
    order, rest = np.argsort(index), np.flatnonzero(c < RARE)
    every = np.concatenate([own[order], rest])
    return pa.table(
        {
            "of_block": words["of_block"][:1],
            "slice": words["slice"][:1],
            "gaps": pa.array([_gaps(index[order])], pa.binary()),
            "places": pa.array([_squeeze(pack(place[every]))], pa.binary()),
            "counts": pa.array([_squeeze(pack_numbers(c[every]))], pa.binary()),
            "classes": pa.array([_squeeze(pack(kind[rest]))], pa.binary()),
        }
    )


def _state_row(number: int, counts: np.ndarray, shares: np.ndarray) -> pa.Table:
    totals = (counts[:, None] * (shares / _STEPS)).sum(axis=0)
    return pa.table(
        {
            "slice": pa.array([number], pa.int64()),
            "c": pa.array([pack_numbers(counts)], pa.binary()),
            "shares": pa.array([_pack_shares(shares)], pa.binary()),
            "totals": pa.array([totals.tolist()], pa.list_(pa.float64())),
        }
    )


_STATE_SCHEMA = "slice long, c binary, shares binary, totals array<double>"


def _first_states(states: int, seed: int):
    """Uneven shares of every word's count set the states apart."""

    def run(words: pa.Table) -> pa.Table:
        order = np.argsort(words["index"].to_numpy())
        counts, number = words["c"].to_numpy()[order], words["slice"][0].as_py()
        pulls = np.random.default_rng([seed, number]).random((len(counts), states)) + 0.05
        return _state_row(number, counts, _shares(counts[:, None] * pulls / pulls.sum(axis=1, keepdims=True), counts))

    return run


def _tell_blocks(states: int):
    """Shares of one slice for the words that each block has of it."""

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        shares = _unpack_shares(known["shares"][0].as_py(), states) if known.num_rows else np.zeros((0, states), np.uint8)
        told = [_pack_shares(shares[_index(g)]) for g in blocks["gaps"].to_pylist()]
        return pa.table({"of_block": blocks["of_block"], "slice": blocks["slice"], "shares": pa.array(told, pa.binary())})

    return run


@dataclass
class _Dictionary:
    """Counts and classes of a block's words by place, their counts in the states (0 for rare
    words), and for every slice its packed index and the places of the words that have such counts."""

    counts: np.ndarray
    classes: np.ndarray
    sums: np.ndarray | None
    slices: list[tuple[int, bytes, np.ndarray]]


def _dictionary(told: pa.Table, states: int) -> _Dictionary:
    fixed = told.filter(pc.is_valid(told["places"]))
    learned = told.filter(pc.is_valid(told["shares"]))
    shares = dict(zip(learned["slice"].to_pylist(), learned["shares"].to_pylist()))
    parts = [
        (r["slice"], r["gaps"], *(zlib.decompress(r[name]) for name in ("places", "counts", "classes")))
        for r in fixed.select(["slice", "gaps", "places", "counts", "classes"]).to_pylist()
    ]
    size = sum(len(p[2]) for p in parts) // 4
    out = _Dictionary(np.zeros(size), np.zeros(size, np.int32), np.zeros((size, states)), [])
    for number, gaps, places, counts, classes in parts:
        places, rest = unpack(places), unpack(classes)
        c = unpack_numbers(counts)
        own = places[: len(places) - len(rest)]
        out.counts[places] = c
        out.classes[places[len(own) :]] = rest
        out.sums[own] = _unpack_shares(shares[number], states) * (c[: len(own), None] / _STEPS)
        out.slices.append((number, gaps, own))
    return out


def _counts_of_blocks(chain: Chain, salts: int):
    states = len(chain.start)

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        known = _dictionary(told, states)
        counts, classes = known.counts, known.classes
        emit, own = chain.emissions(counts, known.sums, classes)
        emit, own, known.sums = emit.astype(np.float32), own.astype(np.float32), None
        seen, moves, starts = np.zeros((len(counts), states)), np.zeros((states, states)), np.zeros(states)
        here = np.zeros(len(counts))
        for _, batch in batches_of([unpack(d) for d in texts["ids"].to_pylist()]):
            for whole, more in zip((seen, moves, starts), expected(chain, batch, emit, len(counts))):
                whole += more
            here += np.bincount(batch.ids, minlength=len(counts))
        # What the base distribution explains of a word is not the state's own.
        seen *= own
        rare = (counts > 0) & (counts < RARE)
        shared = np.stack([np.bincount(classes[rare], weights=seen[rare, k], minlength=CLASSES) for k in range(states)], 1)
        whole = np.concatenate([moves, starts[None, :], shared])
        block = told["of_block"][0].as_py()
        rows = [(-1, block % _SPREAD, None, None, whole.tobytes())]
        for number, gaps, places in known.slices:
            n = here[places]
            rows.append(
                (
                    number,
                    int(_salt(block, salts)),
                    gaps,
                    _squeeze(pack(n)),
                    _pack_shares(_shares(seen[places], n)),
                )
            )
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)]
        return pa.table(columns, names=["slice", "salt", "gaps", "n", "seen"])

    return run


def _salt(block, salts: int):
    """Group of a block, as a number or a column; blocks are numbered in order below their partition's number."""
    return ((block - block % (1 << 32)) / (1 << 32) + block % (1 << 32)) % salts


def _sum_blocks(states: int):
    """Expected counts of one slice over blocks (words x states), in whole 255ths, whose sum no order changes;
    for slice -1 those of whole blocks, as they are."""

    def run(parts: pa.Table) -> pa.Table:
        number = parts["slice"][0].as_py()
        sums = np.zeros((0, states), dtype=np.float64 if number < 0 else np.int64)
        for row in parts.to_pylist():
            if number < 0:
                more, index = np.frombuffer(row["seen"]).reshape(-1, states), slice(None)
                size = len(more)
            else:
                index = _index(row["gaps"])
                more = _unpack_shares(row["seen"], states) * unpack(zlib.decompress(row["n"]))[:, None].astype(np.int64)
                size = int(index[-1]) + 1 if len(index) else 0
            if size > len(sums):
                sums = np.concatenate([sums, np.zeros((size - len(sums), states), sums.dtype)])
            sums[index] += more
        out = sums.tobytes() if number < 0 else _squeeze(pack_numbers(sums.ravel()))
        return pa.table({"slice": pa.array([number], pa.int64()), "sums": pa.array([out], pa.binary())})

    return run


def _next_states(states: int):
    """The state row of a slice from its sums; the row of slice -1 holds the sums of whole blocks as its totals."""

    def run(parts: pa.Table, before: pa.Table) -> pa.Table:
        if before.num_rows == 0:
            whole = sum(np.frombuffer(d) for d in parts["sums"].to_pylist())
            nothing = pa.nulls(1, pa.binary())
            totals = pa.array([whole.tolist()], pa.list_(pa.float64()))
            return pa.table({"slice": pa.array([-1], pa.int64()), "c": nothing, "shares": nothing, "totals": totals})
        counts = unpack_numbers(before["c"][0].as_py())
        sums = np.zeros((len(counts), states), dtype=np.int64)
        for data in parts["sums"].to_pylist():
            more = unpack_numbers(zlib.decompress(data)).reshape(-1, states)
            sums[: len(more)] += more
        shares = (2 * sums + counts[:, None]) // (2 * counts[:, None])
        return _state_row(before["of_slice"][0].as_py(), counts, np.minimum(shares, _STEPS).astype(np.uint8))

    return run


def _scores_of_blocks(chain: Chain):
    states = len(chain.start)

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        known = _dictionary(told, states)
        emit, _ = chain.emissions(known.counts, known.sums, known.classes)
        base = np.log10(chain.base(known.counts))
        coded = [unpack(d) for d in texts["ids"].to_pylist()]
        score = np.empty(len(coded))
        for chosen, batch in batches_of(coded):
            score[chosen] = log_probabilities(chain, batch, emit)
        trained = known.counts > 0
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held_out"],
                "n_tokens": pa.array([len(t) for t in coded], pa.int64()),
                "n_known": pa.array([int(trained[t].sum()) for t in coded], pa.int64()),
                "train_tokens": pa.array(np.full(len(coded), chain.tokens)),
                "base_score": pa.array([float(base[t].sum()) for t in coded], pa.float64()),
                "score": pa.array(score),
            }
        )

    return run


def _totals(sums: DataFrame, states: int) -> np.ndarray:
    found = sums.where("slice >= 0").agg(*[F.sum(F.element_at("totals", k + 1)) for k in range(states)]).first()
    return np.array([v or 0.0 for v in found])


def _chain(before: Chain, sums: DataFrame) -> Chain:
    """Moves, starts and classes from the row of whole blocks, the states' totals from all."""
    states = len(before.start)
    shared = np.array(sums.where("slice = -1").first()["totals"]).reshape(-1, states)
    moves, starts, classes = shared[:states] + 1.0, shared[states] + 1.0, shared[states + 1 :]
    return replace(
        before,
        start=starts / starts.sum(),
        moves=moves / moves.sum(axis=1, keepdims=True),
        totals=_totals(sums, states) + classes.sum(axis=0),
        class_sums=classes,
    )


def score_texts(
    docs: DataFrame,
    states: int = STATES,
    rounds: int = ROUNDS,
    base_share: float = BASE_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Train on the texts that are not held out and score all: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``.

    Texts are numbered once, in blocks with their own dictionaries, and stored by block. Words of ``RARE`` or
    more occurrences have counts of their own in every state and are dealt into slices by hash; what a block
    and a slice have in common is one packed row. Each round of Baum-Welch, the slices tell the blocks how every
    state shares in the counts of their words, the blocks run forwards and backwards, and the slices sum up the
    expected counts (the texts stay where they are). Shares travel in steps of one 255th, and the states' totals
    are those of the shares as they travel, so that every state stays a distribution. Rarer words share the
    counts of their class of endings in proportion to their own; all words have their own count in the
    base distribution. Numbers of the states and classes alone reach the driver.

    A null or empty text is its end alone. A null id is not held out. Rows of one id, repeated ones too, are
    texts like others. Other columns are not read. Without training texts every state is the base
    distribution; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out().alias("held_out"), "text").withColumn("learn", ~F.col("held_out"))
    coded = encode_blocks(rows, words_and_end, _END, ["doc_id", "held_out"], counted="learn", tokens=BLOCK_TOKENS)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"tablelearn_blocks_{uuid.uuid4().hex}"
    with Workspace(spark) as work:
        try:
            coded.write.bucketBy(buckets, "block").option("path", f"{work.path}/blocks").saveAsTable(table)
            blocks = spark.table(table)
            texts = blocks.where("place is null").select("block", "doc_id", "held_out", "ids")
            # Under another name, so that Spark can tell the two sides of the grouping apart.
            words = blocks.where("place is not null").select(F.col("block").alias("of_block"), "word", "place")
            found = blocks.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks"))
            found = work.store(found, "found")
            sizes = found.agg(
                F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
                F.count(F.lit(1)).alias("distinct"),
                F.count_if(F.col("c") >= RARE).alias("own"),
                F.coalesce(F.sum(F.when(F.col("c") >= RARE, F.col("blocks"))), F.lit(0)).alias("pairs"),
            ).first()
            slices = max(1, -(-sizes["own"] // SLICE_WORDS))
            salts = max(1, -(-sizes["pairs"] // (slices * GROUP_WORDS)))
            dealt = F.pmod(F.xxhash64("word"), F.lit(slices))
            by_word = Window.partitionBy("slice").orderBy("word")
            own = found.where(F.col("c") >= RARE).withColumn("slice", dealt)
            own = own.select("slice", "word", "c", (F.row_number().over(by_word) - 1).alias("index"))
            own = work.store(own, "own")
            every = own.select("word", "c", "index").unionByName(
                found.where(F.col("c") < RARE).select("word", "c"), allowMissingColumns=True
            )
            ending = F.crc32(F.substring("word", -2, 2).cast("binary"))
            counted = words.join(every, "word", "left").select(
                "of_block",
                dealt.alias("slice"),
                "place",
                "index",
                F.coalesce("c", F.lit(0)).alias("c"),
                F.pmod(ending, F.lit(CLASSES)).cast("int").alias("class"),
            )
            packed = counted.groupBy("of_block", "slice").applyInArrow(
                _pack_words, "of_block long, slice long, gaps binary, places binary, counts binary, classes binary"
            )
            packed = work.store(packed, "dictionaries")
            sums = own.select("slice", "index", "c").groupBy("slice").applyInArrow(_first_states(states, seed), _STATE_SCHEMA)
            sums = work.store(sums, "sums0")
            class_counts = np.zeros(CLASSES)
            rare = found.where(F.col("c") < RARE).groupBy(F.pmod(ending, F.lit(CLASSES)).alias("class"))
            for r in rare.agg(F.sum("c").alias("c")).collect():
                class_counts[r["class"]] = r["c"]
            pulls = np.random.default_rng(seed).random((CLASSES, states)) + 0.05
            classes = class_counts[:, None] * pulls / pulls.sum(axis=1, keepdims=True)
            moves = np.full((states, states), (1 - STAY) / max(states - 1, 1))
            np.fill_diagonal(moves, STAY if states > 1 else 1.0)
            chain = Chain(
                np.full(states, 1 / states),
                moves,
                _totals(sums, states) + classes.sum(axis=0),
                sizes["tokens"],
                sizes["distinct"],
                base_share,
                classes,
                class_counts,
            )

            def informed():
                """What is known of each block's words: the packed dictionary, and the states' shares."""
                asked = packed.select("of_block", "slice", "gaps", _salt(F.col("of_block"), salts).cast("long").alias("salt"))
                known = sums.where("slice >= 0").select(
                    F.col("slice").alias("of_slice"),
                    "shares",
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("of_salt")
                )
                told = (
                    asked.groupBy("slice", "salt")
                    .cogroup(known.groupBy("of_slice", "of_salt"))
                    .applyInArrow(_tell_blocks(states), "of_block long, slice long, shares binary")
                )
                return packed.unionByName(told, allowMissingColumns=True).groupBy("of_block")

            learn = texts.where(~F.col("held_out")).groupBy("block")
            for i in range(rounds if sizes["tokens"] else 0):
                parts = learn.cogroup(informed()).applyInArrow(
                    _counts_of_blocks(chain, salts), "slice long, salt long, gaps binary, n binary, seen binary"
                )
                summed = parts.groupBy("slice", "salt").applyInArrow(_sum_blocks(states), "slice long, sums binary")
                before = sums.where("slice >= 0").select(F.col("slice").alias("of_slice"), "c")
                after = (
                    summed.groupBy("slice")
                    .cogroup(before.groupBy("of_slice"))
                    .applyInArrow(_next_states(states), _STATE_SCHEMA)
                )
                sums = work.store(after, f"sums{i + 1}")
                chain = _chain(chain, sums)
            kind = docs.schema["doc_id"].dataType.simpleString()
            scored = texts.groupBy("block").cogroup(informed()).applyInArrow(
                _scores_of_blocks(chain),
                f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double",
            )
            return store(scored, "scores")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
