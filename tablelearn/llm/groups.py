"""Pairs within groups of any size, without a row per pair, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.session import store

# Members of a block; a group with more is cut into blocks, and every two of them meet in a cell.
BLOCK = 512


def cells(members: DataFrame, block: int = BLOCK, distinct: bool = True) -> DataFrame:
    """Cells in which all pairs of a group's members meet: cell, node, side.

    ``members`` has the columns group (long) and node (long), each pair of them once.
    Groups of one are left out. A group of at most ``block`` members is one cell; of
    a larger one each cell holds two blocks (side 0 and 1) or one block (side 0), so
    no task gets more than two blocks however large the group is. With ``distinct``,
    of the cells that have the same members only one stays.
    """
    # Written, so that the join that follows has two plain shuffles, of which Spark splits large partitions.
    sizes = store(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = members.join(sizes, "group").select(
        "group", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
    )
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    placed = met.select(
        F.xxhash64("group", low, high).alias("cell"), "node", (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    if not distinct:
        return placed
    marks = [F.bit_xor(F.xxhash64("node", "side", F.lit(s))).alias(f"mark{s}") for s in (1, 2)]
    first = (
        placed.groupBy("cell")
        .agg(*marks, F.count(F.lit(1)).alias("n"))
        .groupBy("mark1", "mark2", "n")
        .agg(F.min("cell").alias("cell"))
        .where("n > 1")
    )
    return placed.join(first.select("cell"), "cell", "left_semi")


def by_cell(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each cell; many small cells share a task and its Python process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if held and held[-1].column("cell")[0] != part.column("cell")[0]:
                    out = work(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
                held.append(part)
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def pairs(side: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell's members in slices: within the cell if it has one side, else across its sides."""
    if side.any():
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step = max(1, most // max(len(right), 1))
        for start in range(0, len(left), step):
            some = left[start : start + step]
            yield np.repeat(some, len(right)), np.tile(right, len(some))
        return
    n = len(side)
    step = max(1, most // max(n, 1))
    for start in range(0, n, step):
        stop = min(start + step, n)
        a, b = np.meshgrid(np.arange(start, stop), np.arange(start, n), indexing="ij")
        kept = a < b
        if kept.any():
            yield a[kept], b[kept]


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one that links lead to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def star_edges(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect what the links connect: each member with its group's first."""
    root = local_roots(len(nodes), left, right)
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node) of every node that has an edge.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to the smallest one, then its smaller ones. The minima are aggregates,
    so no task gathers the edges of a node, though the join with the minima reads them
    in one. Each round is a written table; the number of rounds grows with the
    logarithm of the nodes.
    """
    u, v = F.col("u"), F.col("v")
    links = store(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    before = _mark(links)
    while True:
        # Larger neighbours go to the smallest neighbour (or the node itself).
        both = links.union(links.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        kept = large.where(u != v).distinct()
        # Smaller neighbours and the node itself go to the smallest one.
        least = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m")))
        links = store(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        after = _mark(links)
        if after == before:
            break
        before = after
    return links.select(u.alias("node"), v.alias("component")).union(
        links.select(v.alias("node"), v.alias("component")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    mark: list[Column] = [F.bit_xor(F.xxhash64("u", "v", F.lit(s))) for s in (1, 2)]
    return tuple(links.agg(F.count(F.lit(1)), *mark).first())
