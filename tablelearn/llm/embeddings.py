"""Near-duplicate vectors, found with a forest of random-projection trees.

1. Equal vectors of a label are one node, known by a 64-bit digest.
2. Trees are fitted on a bounded sample: each inner node splits the projections on a
   random direction between their quarter points, where they are sparsest. Every vector
   is routed through all trees; near a split it goes to both sides (spill overlap), so
   that close vectors seldom part. The sample does not grow with the table, but leaves
   do: those with too many vectors get trees of their own, fitted on their own
   vectors, until none is left that can be split.
3. In each leaf, for each label, in cells of bounded size, all cosines are computed;
   the links found connect nodes to clusters, and all pairs of a cluster are then
   compared once, which gives the numbers of links.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.llm.common import mixed
from tablelearn.llm.groups import by_cell, cells, components, pairs, star_edges
from tablelearn.session import store

COSINE = 0.98
TREES = 8
# Vectors the trees are fitted on, about; a documented bound, all vectors are routed and compared.
FIT_ROWS = 20_000
LEAF = 40
# A node whose best cut would send more than this share of it to both sides stays a leaf: a dense
# group is compared in cells instead of being copied at every level.
MOST_DOUBLED = 0.25
# Half width of the overlap, in standard deviations of the difference of two vectors at the threshold.
OVERLAP = 0.75
# Leaves with more vectors are split again, by trees fitted on about so many of their own vectors, if that
# halves their pairs at least; else they are dense and stay whole.
SPLIT_ABOVE = 256
SPLIT_FIT_ROWS = 2_000
FEWER_PAIRS = 0.5
# Vectors of a task's unit of routing, about.
ROUTE_ROWS = 4_096
SEED = 5
CELL_PAIRS = 1 << 16


@dataclass(frozen=True)
class Tree:
    """Inner nodes by number, children of node k being 2k + 1 and 2k + 2."""

    size: int
    directions: dict[int, np.ndarray]
    cuts: dict[int, float]

    def leaves(self, vectors: np.ndarray, overlap: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every vector in every leaf it belongs to."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        open_nodes = [(0, np.arange(len(vectors)))]
        while open_nodes:
            node, held = open_nodes.pop()
            if not len(held):
                continue
            if node not in self.cuts:
                rows.append(held)
                leaves.append(np.full(len(held), node))
                continue
            side = vectors[held] @ self.directions[node] - self.cuts[node]
            open_nodes.append((2 * node + 1, held[side <= overlap]))
            open_nodes.append((2 * node + 2, held[side >= -overlap]))
        return np.concatenate(rows), np.concatenate(leaves)


def fit_tree(sample: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
    rng = np.random.default_rng(seed)
    directions, cuts, open_nodes = {}, {}, [(0, np.arange(len(sample)))]
    while open_nodes:
        node, held = open_nodes.pop()
        if len(held) <= leaf:
            continue
        direction = rng.normal(size=sample.shape[1])
        direction /= np.linalg.norm(direction)
        side = sample[held] @ direction
        cut, doubled = _best_cut(side, overlap_width(sample.shape[1]))
        if doubled > MOST_DOUBLED * len(held):
            continue
        directions[node], cuts[node] = direction, cut
        open_nodes.append((2 * node + 1, held[side <= cut]))
        open_nodes.append((2 * node + 2, held[side > cut]))
    return Tree(sample.shape[1], directions, cuts)


def _best_cut(side: np.ndarray, overlap: float) -> tuple[float, int]:
    """(the cut between the quarter points with the fewest vectors in its overlap, their number)."""
    order = np.sort(side)
    low, high = len(order) // 4, max(len(order) // 4 + 1, 3 * len(order) // 4)
    cuts = (order[low:high] + order[low + 1 : high + 1]) / 2
    doubled = np.searchsorted(order, cuts + overlap, side="right") - np.searchsorted(order, cuts - overlap)
    # The most even one of the best.
    best = min(range(len(cuts)), key=lambda i: (doubled[i], abs(i + low - len(order) // 2)))
    return float(cuts[best]), int(doubled[best])


def overlap_width(size: int) -> float:
    """Unit vectors at the threshold are this far apart on a random direction, times OVERLAP."""
    return OVERLAP * float(np.sqrt(2 - 2 * COSINE) / np.sqrt(size))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(found.flatten(), dtype=np.float64).reshape(-1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay in range.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    """Has components, all of them finite, one of them not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_nodes(vectors: DataFrame) -> DataFrame:
    """node, label, size, vector, n_rows: the distinct usable vectors of each label."""
    # Adding zero makes both zeros one.
    exact = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding")))
        .select("label", exact.alias("vector"))
        .groupBy(F.xxhash64("label", "vector", F.lit(SEED)).alias("node"))
        .agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("size", F.size("vector"))
    )


def fit_forest(nodes: DataFrame, trees: int = TREES, fit_rows: int = FIT_ROWS) -> dict[int, list[Tree]]:
    """Trees for each length of vectors, fitted on about ``fit_rows`` vectors chosen by their digest."""
    total = nodes.count()
    share = min(1.0, fit_rows / total) if total else 1.0
    draw = F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = nodes.where(draw < share).select("node", "size", "vector").toArrow().sort_by("node")
    forest = {}
    sizes = sample["size"].to_numpy()
    for size in sorted(set(sizes.tolist())):
        part = _unit(_matrix(sample.filter(pa.array(sizes == size))["vector"], size))
        forest[size] = [fit_tree(part, SEED + 100 * k) for k in range(trees)]
    return forest


def route(nodes: DataFrame, forest: dict[int, list[Tree]]) -> DataFrame:
    """group, node: every vector in its leaves, a leaf's vectors grouped by label and length.

    Vectors of a length that the sample did not hold share one group per label.
    The forest is broadcast; its size is bounded by the sample.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in sorted(set(sizes.tolist())):
                part = batch.filter(pa.array(sizes == size))
                ids = part.column("node").to_numpy()
                labels = part.column("label_key").to_numpy()
                vectors = _unit(_matrix(part.column("vector"), size))
                for k, tree in enumerate(shared.value.get(size) or [Tree(size, {}, {})]):
                    rows, leaves = tree.leaves(vectors, overlap_width(size))
                    with np.errstate(over="ignore"):
                        key = mixed(labels[rows].astype(np.uint64) + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15))
                        key = mixed(key + leaves.astype(np.uint64) * np.uint64(1009) + np.uint64(k))
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids[rows])], names=["group", "node"])

    return nodes.select("node", "size", "vector", F.xxhash64("label").alias("label_key")).mapInArrow(
        run, "group long, node long"
    )


def _subtree(cell: pa.Table) -> pa.RecordBatch | None:
    """The tree of a leaf, fitted on some of its vectors, if it makes far fewer pairs of them."""
    # By node, so that no order of rows changes the tree.
    cell = cell.sort_by("node")
    sample = _unit(_matrix(cell["vector"], cell["size"][0].as_py()))
    group, total = cell["cell"][0].as_py(), cell["n"][0].as_py()
    # Leaves half as large as allowed, since the overlap adds to them.
    leaf = max(LEAF, len(sample) * SPLIT_ABOVE // (2 * total))
    tree = fit_tree(sample, group & (1 << 63) - 1, leaf)
    _, leaves = tree.leaves(sample, overlap_width(tree.size))
    counts = np.unique(leaves, return_counts=True)[1].astype(np.float64)
    if (counts**2).sum() > FEWER_PAIRS * len(sample) ** 2:
        return None
    return pa.record_batch([pa.array([group], pa.int64()), pa.array([pickle.dumps(tree)])], names=["group", "tree"])


def _route_leaf(cell: pa.Table) -> pa.RecordBatch | None:
    """Some vectors of a leaf in the leaves of its tree, which is one of the rows."""
    is_tree = pc.is_valid(cell["tree"])
    held = cell.filter(pc.invert(is_tree))
    if not held.num_rows:
        return None
    tree: Tree = pickle.loads(cell.filter(is_tree)["tree"][0].as_py())
    rows, leaves = tree.leaves(_unit(_matrix(held["vector"], tree.size)), overlap_width(tree.size))
    with np.errstate(over="ignore"):
        key = mixed(held["group"].to_numpy()[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        key = mixed(key + leaves.astype(np.uint64))
    nodes = pa.array(held["node"].to_numpy()[rows])
    return pa.record_batch([pa.array(key.view(np.int64)), nodes], names=["group", "node"])


def split_large(placed: DataFrame, held: DataFrame) -> DataFrame:
    """group, node with the groups of more than SPLIT_ABOVE vectors split as often as that brings something.

    ``held`` has node, size and vector. Trees are fitted on bounded samples of single
    groups; the vectors of a group are routed in units of about ROUTE_ROWS, so no task
    gets a whole large group. Every split at least about halves the pairs of a group.
    """
    final = None
    while True:
        sizes = store(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT_ABOVE), "large")
        if sizes.isEmpty():
            return placed if final is None else final.unionByName(placed)
        vectors = placed.join(sizes, "group").join(held.select("node", "size", "vector"), "node")
        draw = F.pmod(F.xxhash64("node", "group", F.lit(SEED + 2)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = vectors.where(draw < F.lit(float(SPLIT_FIT_ROWS)) / F.col("n"))
        trees = store(
            by_cell(sample.withColumnRenamed("group", "cell"), _subtree, "group long, tree binary").join(sizes, "group"),
            "subtrees",
        )
        whole = placed.join(trees.select("group"), "group", "left_anti")
        final = whole if final is None else final.unionByName(whole)
        units = F.ceil(F.col("n") / ROUTE_ROWS).cast("int")
        unit = F.xxhash64("group", F.pmod(F.xxhash64("node"), units).cast("int")).alias("cell")
        moved = vectors.join(trees.select("group"), "group", "left_semi").select(
            unit, "group", "node", "vector", F.lit(None).cast("binary").alias("tree")
        )
        guides = trees.select("group", "tree", F.explode(F.sequence(F.lit(0), units - 1)).alias("unit")).select(
            F.xxhash64("group", "unit").alias("cell"),
            "group",
            F.lit(None).cast("long").alias("node"),
            F.lit(None).cast("array<double>").alias("vector"),
            "tree",
        )
        placed = store(by_cell(moved.unionByName(guides), _route_leaf, "group long, node long"), "routed")


def _linked(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, rows they stand for, left and right of the pairs with the same label and length that link)."""
    nodes, side = cell["node"].to_numpy(), cell["side"].to_numpy()
    sizes, labels = cell["size"].to_numpy(), cell["label_key"].to_numpy()
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in sorted(set(sizes.tolist())):
        own = np.flatnonzero(sizes == size)
        unit = _unit(_matrix(cell["vector"].take(pa.array(own)), size))
        for left, right in pairs(side[own], CELL_PAIRS):
            cosine = np.einsum("ij,ij->i", unit[left], unit[right])
            hit = (cosine >= COSINE) & (labels[own[left]] == labels[own[right]])
            lefts.append(own[left[hit]])
            rights.append(own[right[hit]])
    return nodes, cell["n_rows"].to_numpy(), np.concatenate(lefts), np.concatenate(rights)


def _edges(cell: pa.Table) -> pa.RecordBatch | None:
    nodes, _, left, right = _linked(cell)
    a, b = star_edges(nodes, left, right)
    return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None


def _counts(cell: pa.Table) -> pa.RecordBatch | None:
    nodes, n_rows, left, right = _linked(cell)
    links = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(links, left, n_rows[right])
    np.add.at(links, right, n_rows[left])
    some = np.flatnonzero(links)
    return pa.record_batch([pa.array(nodes[some]), pa.array(links[some])], names=["node", "links"]) if len(some) else None


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link if their labels are equal and not null, their vectors have the same
    length and their cosine, in double precision, is COSINE or more. n_links counts
    the other rows linked directly, copies included; component_id is the smallest
    vec_id that links lead to. A vector that is null, empty or zero, or holds a null
    or non-finite component, links with nothing; neither does a row with a null
    vec_id or label. Repeated rows are copies.
    """
    nodes = store(vector_nodes(vectors), "vectors")
    held = nodes.select("node", "size", "vector", "n_rows", F.xxhash64("label").alias("label_key"))
    routed = store(route(nodes, fit_forest(nodes)).distinct(), "routed")
    placed = cells(split_large(routed, held))
    clusters = components(by_cell(placed.join(held, "node"), _edges, "a long, b long"))
    in_clusters = cells(clusters.select("node", F.col("component").alias("group")), distinct=False)
    links = (
        by_cell(in_clusters.join(held, "node"), _counts, "node long, links long")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )
    known = nodes.select("node", "n_rows").join(clusters, "node", "left").join(links, "node", "left")
    exact = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"))
    rows = store(
        vectors.select("vec_id", F.when(usable, F.xxhash64("label", exact, F.lit(SEED))).alias("node")), "vector-rows"
    )
    linked = rows.join(
        known.select(
            "node",
            F.coalesce("component", "node").alias("component"),
            (F.col("n_rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "node",
        "left",
    )
    first = (
        rows.groupBy("node").agg(F.min("vec_id").alias("least"))
        .join(clusters, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min("least").alias("component_id"))
        .where("component is not null")
    )
    return linked.join(first, "component", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
