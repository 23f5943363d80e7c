"""Near-duplicate documents: a Jaccard join on word shingles with Bayesian pruning of candidates.

1. Every whole text becomes its set of five-word shingles. Equal sets are one node,
   known by a 64-bit digest (two different sets share it with probability 2^-64),
   so copies never meet each other in pairs.
2. Nodes that agree in a band of MinHash values are candidates. In cells of bounded
   size their MinHash values are compared a few at a time; a pair is dropped as soon
   as the posterior probability of reaching the threshold, with a uniform prior, is
   below the tolerance. What survives connects nodes to clusters.
3. In each cluster, again in cells, the similarities of all pairs are computed
   exactly from the texts. Links are counted where they are found; only as many edges
   as connect the linked nodes leave a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.llm.common import chunks, mixed, window_hashes, word_hashes, word_spans
from tablelearn.llm.groups import by_cell, cells, components, pairs, star_edges
from tablelearn.session import store

SHINGLE = 5
# The similarity two documents must reach: UPPER / LOWER.
UPPER, LOWER = 4, 5
BANDS, BAND_ROWS = 32, 4
# A pair at the threshold misses all bands with probability 5e-8.
HASHES = BANDS * BAND_ROWS
# MinHash values compared between two decisions, and the probability below which a pair is dropped.
STEP = 32
TOLERANCE = 1e-6
# Documents of a block in the exact comparison.
EXACT_BLOCK = 256

_DRAWS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = (_DRAWS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (_DRAWS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of fewer words, all of them are one shingle."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = word_hashes(data, *word_spans(data))
    if len(words) < SHINGLE:
        # One more value keeps short texts apart from longer ones.
        words = np.append(words, np.uint64(len(words)))
        return window_hashes(words, len(words)) if len(words) > 1 else words[:0]
    return np.unique(window_hashes(words, SHINGLE))


def digest(found: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mixed(found ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(found))
    return int(mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def min_hashes(found: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits; two sets agree in each with the probability of their similarity."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    low = (found >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(low), 1024):
            part = low[start : start + 1024, None] * _FACTORS + _OFFSETS
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for each band."""
    with np.errstate(over="ignore"):
        rows = values.reshape(BANDS, BAND_ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(BAND_ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return key.view(np.int64)


def least_matches(step: int = STEP, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values compared, the fewest matches with which a pair goes on.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1);
    it reaches t with the probability that Binomial(n + 1, t) is at most m.
    """
    t, out = UPPER / LOWER, {}
    for n in range(step, HASHES + 1, step):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def row_key() -> Column:
    """Two hashes of doc_id and text, the same only for rows that repeat both."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), "text", "doc_id").alias("b"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key, node, bands, values of every document (values: the low halves of its MinHash values).

    Without a word the last three are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                nodes, bands, values = [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text)
                    some = len(found) > 0
                    kept = min_hashes(found) if some else None
                    nodes.append(digest(found) if some else None)
                    bands.append(band_keys(kept) if some else None)
                    values.append((kept & 0xFFFF).astype("<u2").tobytes() if some else None)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array(nodes, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(values, pa.binary()),
                    ],
                    names=["doc_id", "key", "node", "bands", "values"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(
        run, f"doc_id {kind}, key struct<a:long,b:long>, node long, bands array<long>, values binary"
    )


def _candidate_edges(rows: DataFrame) -> DataFrame:
    """Edges that connect the pairs of each cell that survive the pruning."""
    needed = least_matches()

    def work(cell: pa.Table) -> pa.RecordBatch | None:
        nodes, side = cell["node"].to_numpy(), cell["side"].to_numpy()
        values = np.frombuffer(b"".join(cell["values"].to_pylist()), dtype="<u2").reshape(len(nodes), HASHES)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for left, right in pairs(side, 1 << 15):
            matches = np.zeros(len(left), dtype=np.int32)
            for n, least in needed.items():
                compared = slice(n - STEP, n)
                matches += (values[left, compared] == values[right, compared]).sum(axis=1, dtype=np.int32)
                go_on = matches >= least
                left, right, matches = left[go_on], right[go_on], matches[go_on]
                if not len(left):
                    break
            kept.append((left, right))
        a, b = star_edges(nodes, *(np.concatenate(x) for x in zip(*kept)))
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

    return by_cell(rows, work, "a long, b long")


def _exact_links(rows: DataFrame) -> DataFrame:
    """For cells with texts: edges (a, b) of linked nodes, and (a, null, links) with the documents linked to a."""

    def work(cell: pa.Table) -> pa.RecordBatch | None:
        found: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        columns = [cell[c].to_pylist() for c in ("node", "side", "n_docs", "text")]
        for node, side, n_docs, text in zip(*columns):
            if (node, side) not in found:
                own = shingles(text)
                if len(own):
                    found[node, side] = (own, n_docs)
        if len(found) < 2:
            return None
        nodes = np.array([k[0] for k in found], dtype=np.int64)
        side = np.array([k[1] for k in found])
        weight = np.array([v[1] for v in found.values()], dtype=np.int64)
        sets = [v[0] for v in found.values()]
        sizes = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        links, ends = np.zeros(len(nodes), dtype=np.int64), [[], []]
        held = np.zeros(codes.max() + 1, dtype=np.int32)
        two_sided = side.any()
        for i in range(len(nodes)):
            if two_sided and side[i]:
                continue
            own = codes[starts[i] : starts[i] + sizes[i]]
            held[own] = 1
            common = np.add.reduceat(held[codes], starts)
            held[own] = 0
            linked = LOWER * common >= UPPER * (sizes + sizes[i] - common)
            linked &= (side == 1) if two_sided else (np.arange(len(nodes)) > i)
            others = np.flatnonzero(linked)
            links[i] += weight[others].sum()
            links[others] += weight[i]
            ends[0].append(np.full(len(others), i))
            ends[1].append(others)
        a, b = star_edges(nodes, np.concatenate(ends[0]), np.concatenate(ends[1]))
        some = np.flatnonzero(links)
        return pa.record_batch(
            [
                pa.array(np.concatenate([a, nodes[some]])),
                pa.array([*b.tolist(), *[None] * len(some)], pa.int64()),
                pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]])),
            ],
            names=["a", "b", "links"],
        )

    return by_cell(rows, work, "a long, b long, links long")


def _linked_nodes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, doc_id (the smallest), key (of its row), n_docs, component, links of every node of the sketches."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    nodes = store(
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.min(first).alias("first"),
            F.count(F.lit(1)).alias("n_docs"),
            F.first("bands").alias("bands"),
            F.first("values").alias("values"),
        )
        .select("node", "first.doc_id", "first.key", "n_docs", "bands", "values"),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("group"))
    candidates = cells(members).join(nodes.select("node", "values"), "node")
    clusters = components(_candidate_edges(candidates))
    # One text per key, chosen in the tasks before the shuffle: equal rows are one node.
    texts = docs.select(row_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    placed = cells(clusters.select("node", F.col("component").alias("group")), EXACT_BLOCK, distinct=False)
    with_texts = placed.join(nodes.select("node", "key", "n_docs"), "node").join(texts, "key")
    found = store(_exact_links(with_texts.select("cell", "node", "side", "n_docs", "text")), "links")
    classes = components(found.where("b is not null"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    return (
        nodes.select("node", "doc_id", "key", "n_docs")
        .join(classes, "node", "left")
        .join(links.withColumnRenamed("a", "node"), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: one row of each class stays.

    Classes are those of ``near_duplicates``, by text and not by doc_id: rows that
    share a doc_id or have none are documents like others. The row with the smallest
    doc_id stays, one without a doc_id only if the class has no other; of rows that
    repeat doc_id and text any one. Rows without words are in no class and all stay.
    """
    known = _linked_nodes(docs, store(sketch(docs), "sketches"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    kept = known.groupBy("component").agg(first).select(F.col("first.key").alias(name))
    has_words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    columns = [quoted(c) for c in docs.columns]
    # Both sides of the join are dealt by the key, as is the choice of one row.
    chosen = docs.where(has_words).withColumn(name, row_key()).join(kept, name).dropDuplicates([name])
    return chosen.select(*columns).union(docs.where(~has_words))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Class and number of links of every document: doc_id, class_id, n_links, kept.

    Two documents link if the sets of their five-word shingles have a Jaccard
    similarity of 0.8 or more; a document with fewer words has one shingle, all its
    words. class_id is the smallest doc_id that links lead to, itself included;
    n_links counts the other rows that link directly, copies included. kept: the
    document gives the class its id. A document without words (null, empty, blanks)
    links with nothing. A row with a null doc_id links like any other but gives no
    class its id. Repeated rows are copies.
    """
    rows = store(sketch(docs), "sketches")
    known = _linked_nodes(docs, rows)
    first = known.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    # Only nodes with a copy or a link differ from the default.
    known = (
        known.where("n_docs > 1 or links is not null")
        .join(first, "component")
        .select("node", "class_id", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    own = rows.select(F.col("doc_id").alias("id"), "node").join(known, "node", "left")
    return own.select(
        F.col("id").alias("doc_id"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))
