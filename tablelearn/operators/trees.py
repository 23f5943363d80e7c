"""Boosted trees and forests from histograms, for many fits of one table at once.

Columns are cut into bins once. All fits then grow their trees in lockstep: a job sums the
histograms of every open node of every fit over the partitions and picks the best split of each, so that fits cost the jobs
of the longest one. A table small enough to be broadcast is sent to the tasks instead, and each finishes whole fits by the same
steps, in Java (``Grower.java``) or, where that cannot be had, here; all ways give the same trees.
"""

from __future__ import annotations

import base64
import heapq
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, functions as F

from tablelearn.operators import grower
from tablelearn.operators.features import JsonStage
from tablelearn.session import Workspace

FEATURES, LABEL = "features", "__label"
# Rows and bytes of a binned table that may be broadcast, and rows of it that pass the driver at a time.
SMALL_ROWS, SMALL_BYTES, PIECE_ROWS = 4_000_000, 128 << 20, 1 << 16
# Trees of a forest that are grown at a time, and rounds after which margins are written.
GROUP, WRITTEN = 10, 10
# Nodes of a model that a task keeps unpacked while it predicts; the rest is unpacked again for every batch.
KEPT_NODES = 8_000_000
# Cells of a histogram a task holds at a time.
CELLS = 1 << 21
# Columns of a node that are summed at a time, and values of them.
COLUMNS, VALUES = 8, 1 << 15
# A summary of a column keeps so many values per bin.
KEPT = 4
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 30.0)])))


@dataclass(frozen=True)
class TreePlan:
    """One fit. ``classes`` is 0 for numbers; ``fold`` names rows the fit does not see; unset limits do not bind.

    Boosting fits Newton steps: squared error, one logistic margin for two classes, softmax with one tree per class
    and round for more. Its first round takes the full step, later ones ``rate`` of it. Forests draw rows by a
    Poisson count of mean one, and with ``root_columns`` the root of the number of columns at every node.
    """

    boosted: bool
    classes: int = 0
    trees: int = 100
    max_depth: int | None = None
    max_leaves: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    rate: float = 0.3
    subsample: float = 1.0
    tree_columns: float = 1.0
    root_columns: bool = False
    bootstrap: bool = True
    penalty: float = 0.0
    bins: int = 256
    seed: int = 42
    fold: int | None = None

    @property
    def width(self) -> int:
        """Margins of a row: one per class, or one."""
        return self.classes if self.classes > 2 or (self.classes and not self.boosted) else 1

    def rounds(self) -> int:
        return self.trees if self.boosted else -(-self.trees // GROUP)

    def units(self, number: int) -> list[tuple[int, int]]:
        """Trees of a round, as (number of the tree, margin it adds to); a forest's trees add to all."""
        if self.boosted:
            return [(number, k) for k in range(self.width)]
        return [(t, 0) for t in range(number * GROUP, min((number + 1) * GROUP, self.trees))]


# ---------------------------------------------------------------- draws


def _uniform(seed: int, *parts: Any) -> np.ndarray:
    """Numbers in [0, 1) that depend on the seed and the parts (whole numbers or arrays of them) alone."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        for part in parts:
            x = (x + np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def drawn_rows(plan: TreePlan, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree sees each row."""
    if plan.subsample >= 1.0 if plan.boosted else not plan.bootstrap:
        return np.ones(len(rows))
    u = _uniform(plan.seed, 1, tree, rows)
    if plan.boosted:
        return (u < plan.subsample).astype(float)
    return np.searchsorted(_POISSON, u, side="right").astype(float)


def drawn_columns(plan: TreePlan, tree: int, nodes: Sequence[int], columns: int) -> np.ndarray:
    """Which columns (second axis) each node may be split at: those with the smallest draws, at least one."""
    open_ = np.ones((len(nodes), columns), dtype=bool)
    every = np.arange(columns)
    own = int(columns**0.5) if plan.root_columns else columns
    for most, draws in (
        (int(plan.tree_columns * columns), lambda: _uniform(plan.seed, 2, tree, every)[None, :]),
        (own, lambda: _uniform(plan.seed, 3, tree, np.asarray(nodes, dtype=np.int64)[:, None], every[None, :])),
    ):
        if most < columns:
            order = np.broadcast_to(np.argsort(draws(), axis=1, kind="stable"), open_.shape)
            np.put_along_axis(open_, order[:, max(1, most) :], False, axis=1)
    return open_


# ---------------------------------------------------------------- one tree


@dataclass
class Split:
    """Rows with at most ``bin`` in ``column`` go left; ``left`` and ``right`` are the sums of the two sides."""

    gain: float
    column: int
    bin: int
    left: np.ndarray
    right: np.ndarray


@dataclass
class Growing:
    """A tree while it grows: nodes in the order they were made, and what is known of their best splits.

    With a limit on leaves the tree is grown best first. A node whose split is not known yet but that
    the best-first order could reach is pending; splits of reached nodes are kept, and the order is played again
    after each answer until nothing is pending.
    """

    plan: TreePlan
    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list[np.ndarray | None] = field(default_factory=list)
    known: dict[int, Split | None] = field(default_factory=dict)
    pending: list[int] = field(default_factory=list)
    chosen: set[int] = field(default_factory=set)

    def __post_init__(self):
        self._new(0, None)
        self.pending = [0]

    def _new(self, depth: int, sums: np.ndarray | None) -> int:
        node, plan = len(self.depth), self.plan
        self.column.append(-1)
        self.bin.append(0)
        self.left.append(-1)
        self.right.append(-1)
        self.depth.append(depth)
        self.sums.append(sums)
        if sums is not None and (
            plan.max_depth is not None and depth >= plan.max_depth or sums[-1] < max(plan.min_split, 2 * plan.min_leaf)
        ):
            self.known[node] = None
        return node

    def _split(self, node: int) -> list[int]:
        if self.left[node] < 0:
            best = self.known[node]
            self.column[node], self.bin[node] = best.column, best.bin
            self.left[node] = self._new(self.depth[node] + 1, best.left)
            self.right[node] = self._new(self.depth[node] + 1, best.right)
        return [self.left[node], self.right[node]]

    def tell(self, total: np.ndarray | None, found: dict[int, Split]) -> None:
        """Best splits of the pending nodes (none for those left out), and the sums of the root with its answer."""
        answered, self.pending = self.pending, []
        for node in answered:
            self.known[node] = found.get(node)
        if self.sums[0] is None:
            self.sums[0] = total
            if total[-1] < self.plan.min_split or self.plan.max_depth == 0:
                self.known[0] = None
        if self.plan.max_leaves is None:
            for node in answered:
                if self.known[node] is not None:
                    self.chosen.add(node)
                    self.pending += [c for c in self._split(node) if c not in self.known]
            return
        self.chosen, leaves, heap, fresh = set(), 1, [], [0]
        while True:
            for node in fresh:
                if node not in self.known:
                    self.pending.append(node)
                elif self.known[node] is not None:
                    heapq.heappush(heap, (-self.known[node].gain, node))
            if not heap or leaves >= self.plan.max_leaves:
                break
            node = heapq.heappop(heap)[1]
            fresh = self._split(node)
            self.chosen.add(node)
            leaves += 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        """All nodes made so far, for routing."""
        return tuple(np.array(v, dtype=np.int64) for v in (self.column, self.bin, self.left, self.right))

    def _numbered(self) -> tuple[dict[int, int], list[int]]:
        number, order = {0: 0}, [0]
        for node in order:
            if node in self.chosen:
                for child in (self.left[node], self.right[node]):
                    number[child] = len(order)
                    order.append(child)
        return number, order

    def places(self) -> np.ndarray:
        """For every node made, its number in the finished tree or that of the leaf it lies below."""
        number, _ = self._numbered()
        place = np.zeros(len(self.depth), dtype=np.int64)
        for node, left in enumerate(self.left):
            place[node] = number.get(node, place[node])
            if left >= 0:
                place[left] = place[left + 1] = place[node]
        return place

    def finished(self) -> dict[str, np.ndarray]:
        """The tree of the chosen splits alone."""
        number, order = self._numbered()
        some = [n in self.chosen for n in order]
        return {
            "column": np.array([self.column[n] if s else -1 for n, s in zip(order, some)], dtype=np.int32),
            "bin": np.array([self.bin[n] if s else 0 for n, s in zip(order, some)], dtype=np.int32),
            "left": np.array([number[self.left[n]] if s else -1 for n, s in zip(order, some)], dtype=np.int32),
            "right": np.array([number[self.right[n]] if s else -1 for n, s in zip(order, some)], dtype=np.int32),
            "gain": np.array([self.known[n].gain if s else 0.0 for n, s in zip(order, some)]),
            "value": _value(np.array([self.sums[n] for n in order]), self.plan.penalty),
        }


def route(x: np.ndarray, node: np.ndarray, arrays: Sequence[np.ndarray]) -> np.ndarray:
    """The leaf every row ends in, from the node it is at."""
    column, cut, left, right = arrays
    moving = np.flatnonzero(column[node] >= 0)
    while len(moving):
        at = node[moving]
        goes_left = x[moving, column[at]] <= cut[at]
        node[moving] = np.where(goes_left, left[at], right[at])
        moving = moving[column[node[moving]] >= 0]
    return node


def grid(rows: int, largest: float) -> float:
    """Step to which what is summed over so many rows is rounded, so that the sums are exact in any order.

    It is a power of two, about 1e-15 of the largest possible sum; 0 if nothing can be rounded.
    """
    most = 8.0 * max(rows, 1) * largest
    return float(np.ldexp(1.0, int(np.ceil(np.log2(most))) - 52)) if np.isfinite(most) and most > 0 else 0.0


def _on_grid(values: np.ndarray, step: float) -> np.ndarray:
    return np.rint(values / step) * step if step else values


def parts_of(
    plan: TreePlan, label: np.ndarray, margins: np.ndarray, output: int, seen: np.ndarray, step: float
) -> list[np.ndarray]:
    """What a node needs of every row, to be summed: gradients, one or one per class; curvature; how often it is seen."""
    if not plan.boosted:
        if plan.classes:
            return [np.where(label == k, seen, 0.0) for k in range(plan.classes)] + [seen, seen]
        return [_on_grid(label * seen, step), seen, seen]
    if not plan.classes:
        return [_on_grid((label - margins[:, 0]) * seen, step), seen, seen]
    if plan.width == 1:
        p = 1.0 / (1.0 + np.exp(-margins[:, 0]))
        slope = label - p
    else:
        powers = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = powers[:, output] / powers.sum(axis=1)
        slope = (label == output) - p
    curve = np.maximum(_on_grid(p * (1 - p), step), max(step, 1e-16))
    return [_on_grid(slope, step) * seen, curve * seen, seen]


def gradients(
    plan: TreePlan, label: np.ndarray, margins: np.ndarray, tree: int, output: int, rows: np.ndarray, step: float
) -> np.ndarray:
    """``parts_of`` the rows of a tree, a column each."""
    return np.column_stack(parts_of(plan, label, margins, output, drawn_rows(plan, tree, rows), step))


def _value(sums: np.ndarray, penalty: float) -> np.ndarray:
    below = sums[..., -2:-1] + penalty
    return np.divide(sums[..., :-2], below, out=np.zeros_like(sums[..., :-2]), where=below > 0)


def _gain(sums: np.ndarray, penalty: float) -> np.ndarray:
    return (_value(sums, penalty) * sums[..., :-2]).sum(axis=-1)


def _gains(left: np.ndarray, right: np.ndarray, plan: TreePlan) -> np.ndarray:
    """Gains of splits into these sums, -inf where a side is too small or nothing is gained.

    They are rounded to 24 bits, so that sums added in another order choose the same one of equal splits.
    """
    parts = _gain(left, plan.penalty) + _gain(right, plan.penalty)
    gain = parts - _gain(left + right, plan.penalty)
    least = max(plan.min_leaf, 1)
    enough = (left[..., -1] >= least) & (right[..., -1] >= least) & (gain > 1e-9 * parts)
    return np.where(enough, _rounded(gain), -np.inf)


def _rounded(gain: np.ndarray) -> np.ndarray:
    share, power = np.frexp(gain)
    return np.ldexp(np.round(share * (1 << 24)), power - 24)


def best_bin(histogram: np.ndarray, column: int, plan: TreePlan) -> Split | None:
    """Best split by one column, from its histogram (bins x sums)."""
    upto = histogram.cumsum(axis=0)
    gain = _gains(upto[:-1], upto[-1] - upto[:-1], plan)
    if not len(gain) or not np.isfinite(gain.max()):
        return None
    at = int(gain.argmax())
    return Split(float(gain[at]), column, at, upto[at], upto[-1] - upto[at])


@dataclass
class Best:
    """Best splits of some nodes, by place; a gain of -inf says that there is none."""

    gain: np.ndarray
    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    total: np.ndarray

    @classmethod
    def none(cls, nodes: int, kinds: int) -> Best:
        whole = np.zeros(nodes, dtype=np.int64)
        return cls(np.full(nodes, -np.inf), whole, whole.copy(), np.zeros((nodes, kinds)), np.zeros((nodes, kinds)))


def _cells(place: np.ndarray, parts: Sequence[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cells that hold rows, ascending, and the sums of the parts in each."""
    sums: list[np.ndarray] = []
    if most > max(1 << 18, 16 * len(place)):
        # Far more cells than rows: only those in use are numbered.
        cells, place = np.unique(place, return_inverse=True)
        held = np.bincount(place, weights=parts[-1], minlength=len(cells))
        among: Any = slice(None)
    else:
        held = np.bincount(place, weights=parts[-1], minlength=most)
        cells = among = np.flatnonzero(held > 0)
    seen = held[among]
    for k, part in enumerate(parts[:-1]):
        first = next((j for j in range(k) if parts[j] is part), None)
        if part is parts[-1]:
            sums.append(seen)
        elif first is not None:
            sums.append(sums[first])
        else:
            sums.append(np.bincount(place, weights=part, minlength=len(held))[among])
    return cells, [*sums, seen]


def _shares(sums: Sequence[np.ndarray], penalty: float) -> np.ndarray:
    """``_gain`` of sums that come part by part; not a number where nothing was summed."""
    with np.errstate(divide="ignore", invalid="ignore"):
        below = sums[-2] + penalty
        return sum(slope / below * slope for slope in sums[:-2])


def _starts(owner: np.ndarray) -> np.ndarray:
    """Where each run of an ascending array begins."""
    return np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])


def best_splits(
    x: np.ndarray, rows: np.ndarray | None, slot: np.ndarray, parts: Sequence[np.ndarray], open_: np.ndarray, bins: int, plan: TreePlan
) -> Best:
    """Best split of every node. ``x`` has a line per column; ``rows`` (all if none) lie in the nodes at ``slot``.

    The rows of every node, column and bin are summed, some of a node's columns at a time; only cells in use are looked at.
    """
    nodes, kinds, n = len(open_), len(parts), x.shape[1]
    best = Best.none(nodes, kinds)
    shift = max(1, int(bins - 1).bit_length())
    mine = {id(p): p if rows is None else p[rows] for p in parts}
    used = np.flatnonzero(open_.any(axis=0))
    same = bool(open_[:, used].all())
    most = len(used) if same else int(open_.sum(axis=1).max(initial=0))
    if not most or not len(slot):
        return best
    # Every node's columns, ascending; nodes with fewer than others have closed ones at the end.
    own = np.broadcast_to(used, (nodes, most)) if same else np.argsort(~open_, axis=1, kind="stable")[:, :most]
    ends = not same and not np.take_along_axis(open_, own[:, -1:], axis=1).all()
    at_once = max(1, min(COLUMNS, VALUES // len(slot)))
    for first in range(0, most, at_once):
        columns = own[:, first : first + at_once]
        width = columns.shape[1]
        if same:
            values = x[columns[0]] if rows is None else x[columns[0][:, None], rows]
        else:
            values = x.ravel()[columns.T[:, slot] * n + (np.arange(n) if rows is None else rows)]
        place = values + ((slot * width) << shift)
        place += (np.arange(width) << shift)[:, None]
        repeated = {k: p if width == 1 else np.broadcast_to(p, (width, len(p))).reshape(-1) for k, p in mine.items()}
        cells, sums = _cells(place.ravel(), [repeated[id(p)] for p in parts], (nodes * width) << shift)
        if not len(cells):
            continue
        owner = cells >> shift
        starts = _starts(owner)
        sizes = np.diff(starts, append=len(owner))
        left, total, right, known = [], [], [], {}
        for held in sums:
            if id(held) not in known:
                every = np.add.reduceat(held, starts)
                # Running sums that begin anew for every node and column.
                upto = held.copy()
                upto[starts[1:]] -= every[:-1]
                upto.cumsum(out=upto)
                known[id(held)] = upto, every, np.repeat(every, sizes) - upto
            for out, own_sums in zip((left, total, right), known[id(held)]):
                out.append(own_sums)
        both = _shares(left, plan.penalty) + _shares(right, plan.penalty)
        gain = both - np.repeat(_shares(total, plan.penalty), sizes)
        least = max(plan.min_leaf, 1)
        gain[~((left[-1] >= least) & (right[-1] >= least) & (gain > 1e-9 * both))] = -np.inf
        if ends:
            shut = ~np.take_along_axis(open_, columns, axis=1).ravel()
            gain[shut[owner]] = -np.inf
        # Gains are compared rounded; only those near a node's largest can be as large as it then. Of equal ones the
        # first column counts, and its first bin.
        node = owner // width
        heads = _starts(node)
        lengths = np.diff(heads, append=len(node))
        near = np.flatnonzero((gain >= np.repeat(np.maximum.reduceat(gain, heads) * (1 - 1e-6), lengths)) & np.isfinite(gain))
        if not len(near):
            continue
        shown, at = _rounded(gain[near]), node[near]
        top = np.full(nodes, -np.inf)
        np.maximum.at(top, at, shown)
        k = np.flatnonzero(shown == top[at])
        k = k[_starts(at[k])]
        k = k[shown[k] > best.gain[at[k]]]
        g, k = shown[k], near[k]
        m = node[k]
        best.gain[m], best.column[m], best.bin[m] = g, columns[m, owner[k] % width], cells[k] & ((1 << shift) - 1)
        a = np.searchsorted(starts, k, side="right") - 1
        for j in range(kinds):
            best.left[m, j], best.total[m, j] = left[j][k], total[j][a]
    return best


def _undecided(plan: TreePlan, sums: np.ndarray) -> np.ndarray:
    """Which nodes can gain by a split at all: those of a class forest whose rows are of several classes."""
    if plan.boosted or not plan.classes:
        return np.ones(len(sums), dtype=bool)
    return sums[:, : plan.classes].max(axis=1) < sums[:, -1]


def grow_tree(plan: TreePlan, tree: int, x: np.ndarray, parts: Sequence[np.ndarray], bins: int) -> tuple[dict, np.ndarray]:
    """A tree from rows that are all seen, as its ``finished`` arrays, and the leaf of every row."""
    total = np.array([p.sum() for p in parts])
    if plan.max_leaves is not None:
        return _grow_leaves(plan, tree, x, parts, bins, total)
    n = x.shape[1]
    leaf, rows, slot = np.zeros(n, dtype=np.int64), None, np.zeros(n, dtype=np.int64)
    flat = x.ravel()
    column, bin_, gain, sums = [np.full(1, -1)], [np.zeros(1, dtype=np.int64)], [np.zeros(1)], [total[None, :]]
    made, depth, pending = 1, 0, np.zeros(1, dtype=np.int64)
    if total[-1] < plan.min_split or plan.max_depth == 0 or not _undecided(plan, total[None, :])[0]:
        pending = pending[:0]
    while len(pending):
        # ``pending`` are places in the newest level, whose nodes are numbered up to ``made``.
        first = made - len(column[-1])
        best = best_splits(x, rows, slot, parts, drawn_columns(plan, tree, first + pending, len(x)), bins, plan)
        split = np.flatnonzero(np.isfinite(best.gain))
        if not len(split):
            break
        column[-1][pending[split]], bin_[-1][pending[split]] = best.column[split], best.bin[split]
        gain[-1][pending[split]] = best.gain[split]
        rank = np.full(len(pending), -1)
        rank[split] = np.arange(len(split))
        if len(split) < len(pending):
            stay = np.flatnonzero(rank[slot] >= 0)
            rows, slot = stay if rows is None else rows[stay], slot[stay]
        at = best.column[slot] * n + (np.arange(n) if rows is None else rows)
        child = 2 * rank[slot] + (flat[at] > best.bin[slot])
        leaf[slice(None) if rows is None else rows] = made + child
        new = np.empty((2 * len(split), len(parts)))
        new[0::2], new[1::2] = best.left[split], best.total[split] - best.left[split]
        column.append(np.full(len(new), -1))
        bin_.append(np.zeros(len(new), dtype=np.int64))
        gain.append(np.zeros(len(new)))
        sums.append(new)
        made, depth = made + len(new), depth + 1
        if plan.max_depth is not None and depth >= plan.max_depth:
            break
        going = (new[:, -1] >= max(plan.min_split, 2 * plan.min_leaf)) & _undecided(plan, new)
        pending = np.flatnonzero(going)
        if len(pending) == len(new):
            slot = child
        else:
            stay = np.flatnonzero(going[child])
            rows, slot = stay if rows is None else rows[stay], (np.cumsum(going) - 1)[child[stay]]
    column, sums = np.concatenate(column).astype(np.int32), np.concatenate(sums)
    left = first_children(column)
    return {
        "column": column,
        "bin": np.concatenate(bin_).astype(np.int32),
        "left": left,
        "right": np.where(left >= 0, left + 1, -1).astype(np.int32),
        "gain": np.concatenate(gain),
        "value": _value(sums, plan.penalty),
    }, leaf


def first_children(column: np.ndarray) -> np.ndarray:
    """Left children of a tree whose nodes are numbered level by level; the right ones follow them."""
    inner = column >= 0
    return np.where(inner, 2 * np.cumsum(inner) - 1, -1).astype(np.int32)


def _grow_leaves(plan, tree, x, parts, bins, total) -> tuple[dict, np.ndarray]:
    growing, node = Growing(plan), np.zeros(x.shape[1], dtype=np.int64)
    while growing.pending:
        pending = np.array(growing.pending)
        slots = np.full(len(growing.depth), -1)
        slots[pending] = np.arange(len(pending))
        slot = slots[node]
        rows = None if (slot >= 0).all() else np.flatnonzero(slot >= 0)
        open_ = drawn_columns(plan, tree, pending, len(x))
        best = best_splits(x, rows, slot if rows is None else slot[rows], parts, open_, bins, plan)
        found = {
            growing.pending[k]: Split(
                float(best.gain[k]), int(best.column[k]), int(best.bin[k]), best.left[k], best.total[k] - best.left[k]
            )
            for k in np.flatnonzero(np.isfinite(best.gain)).tolist()
        }
        growing.tell(total, found)
        column, cut, left, _ = growing.arrays()
        node = descend(x, node, column, cut, left)
    # Nodes that were tried but not chosen give their rows back to the leaf above them.
    place = growing.places()
    return growing.finished(), place[node]


def descend(x: np.ndarray, node: np.ndarray, column: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf every row ends in, from the node it is at; ``x`` has a line per column, right children follow left ones."""
    n, flat = x.shape[1], x.ravel()
    node = node.astype(np.int64)
    moving = np.flatnonzero(column[node] >= 0)
    at = node[moving]
    while len(moving):
        at = left[at] + (flat[column[at].astype(np.int64) * n + moving] > cut[at])
        node[moving] = at
        on = np.flatnonzero(column[at] >= 0)
        moving, at = moving[on], at[on]
    return node


def node_histograms(
    x: np.ndarray, node: np.ndarray, sums: np.ndarray, pending: Sequence[int], bins: int
) -> Iterator[tuple[list[int], np.ndarray]]:
    """Histograms (node, column, bin, sum) of the pending nodes, some nodes at a time."""
    columns, kinds = x.shape[1], sums.shape[1]
    at_once = max(1, CELLS // max(1, columns * bins * kinds))
    used = np.flatnonzero(sums[:, -1] > 0)
    for start in range(0, len(pending), at_once):
        some = list(pending[start : start + at_once])
        slots = np.full(max(int(node.max(initial=0)), *some) + 1, -1, dtype=np.int64)
        slots[some] = np.arange(len(some))
        mine = used[slots[node[used]] >= 0]
        slot = slots[node[mine]] * bins
        out = np.empty((len(some), columns, bins, kinds))
        for c in range(columns):
            place = slot + x[mine, c]
            for k in range(kinds):
                out[:, c, :, k] = np.bincount(place, weights=sums[mine, k], minlength=len(some) * bins).reshape(-1, bins)
        yield some, out


def _step(plan: TreePlan, number: int) -> float:
    return plan.rate if plan.boosted and number else 1.0


def grow_rounds(
    plan: TreePlan, x, label, fold, rows, numbers: Sequence[int], step: float, keep: bool, only: int | None = None
):
    """Trees of these rounds (if they are kept) and else the margins they give the rows of the plan's fold.

    ``x`` has a line per column; with ``only`` a forest grows the tree at that place of each round alone.
    """
    bins = int(x.max(initial=0)) + 1
    held = np.zeros(len(label), dtype=bool) if plan.fold is None else fold == plan.fold
    asked = np.ascontiguousarray(x[:, held])
    x, label, rows = (np.ascontiguousarray(x[:, ~held]), label[~held], rows[~held]) if held.any() else (x, label, rows)
    margins, out = np.zeros((len(label) if plan.boosted else 0, plan.width)), np.zeros((asked.shape[1], plan.width))
    trees = []
    for number in numbers:
        added = []
        for tree, output in plan.units(number) if only is None else plan.units(number)[only : only + 1]:
            seen = drawn_rows(plan, tree, rows)
            used = np.flatnonzero(seen)
            every = len(used) == len(seen)
            if every:
                found, leaf = grow_tree(plan, tree, x, parts_of(plan, label, margins, output, seen, step), bins)
            else:
                mine = margins[used] if plan.boosted else margins
                parts = parts_of(plan, label[used], mine, output, seen[used], step)
                found, leaf = grow_tree(plan, tree, x.take(used, axis=1), parts, bins)
            if keep:
                trees.append((output, number, found))
            if plan.boosted:
                added.append((output, found, None if every else used, leaf))
            elif len(out):
                out += found["value"][_leaves(found, asked)]
        for output, found, used, leaf in added:
            value = found["value"][:, 0] * _step(plan, number)
            if used is None:
                margins[:, output] += value[leaf]
            else:
                margins[used, output] += value[leaf]
                rest = np.ones(len(label), dtype=bool)
                rest[used] = False
                rest = np.flatnonzero(rest)
                margins[rest, output] += value[_leaves(found, x.take(rest, axis=1))]
            if len(out):
                out[:, output] += value[_leaves(found, asked)]
    return trees, out


def _leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    return descend(x, np.zeros(x.shape[1], dtype=np.int64), tree["column"], tree["bin"], tree["left"])


def _add(plan: TreePlan, margins: np.ndarray, x: np.ndarray, output: int, number: int, tree: dict) -> None:
    leaf = route(x, np.zeros(len(x), dtype=np.int64), [tree[k].astype(np.int64) for k in ("column", "bin", "left", "right")])
    found = tree["value"][leaf] * _step(plan, number)
    if plan.boosted:
        margins[:, output] += found[:, 0]
    else:
        margins += found


# ---------------------------------------------------------------- bins


def _thinned(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the sorted distinct values, each standing for the weights since the one before."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    values, weights = values[new], np.add.reduceat(weights, new) if len(new) else weights
    if len(values) <= most:
        return values, weights
    upto = weights.cumsum()
    at = np.unique(np.searchsorted(upto, (np.arange(1, most + 1) / most) * upto[-1] * (1 - 1e-12)))
    return values[at], np.diff(np.concatenate([[0.0], upto[at]]))


def learn_cuts(df: DataFrame, bins: int) -> list[np.ndarray]:
    """Limits between the bins of each column: between all its values if they are few, else at about equal shares.

    A task keeps a few values per bin and column; these are merged by column.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            for c in range(x.shape[1]):
                new = _thinned(x[:, c], np.ones(len(x)), KEPT * bins)
                if c < len(held):
                    new = _thinned(*(np.concatenate(p) for p in zip(held[c], new)), KEPT * bins)
                    held[c] = new
                else:
                    held.append(new)
        for c, (values, weights) in enumerate(held):
            yield pa.record_batch(
                [pa.array([c], pa.int32()), pa.array([values.tolist()]), pa.array([weights.tolist()])],
                names=["column", "values", "weights"],
            )

    def merge(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.array(v) for v in table["values"].to_pylist()])
        weights = np.concatenate([np.array(v) for v in table["weights"].to_pylist()])
        values, weights = _thinned(values, weights, KEPT * bins)
        if len(values) > bins:
            values, _ = _thinned(values, weights, bins)
        cuts = values[:-1] + (values[1:] - values[:-1]) / 2
        return pa.table({"column": table["column"][:1], "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    kinds = "column int, values array<double>, weights array<double>"
    found = (
        df.select(vector_to_array(FEATURES).alias("x"))
        .mapInArrow(summarise, kinds)
        .groupBy("column")
        .applyInArrow(merge, "column int, cuts array<double>")
    )
    return [np.array(r["cuts"]) for r in sorted(found.collect(), key=lambda r: r["column"])]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def into_bins(df: DataFrame, cuts: Sequence[np.ndarray], kind: str, fold: str | None) -> DataFrame:
    """``row, bins, label, fold``; a row's number is unique once the table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            coded = np.empty(x.shape, dtype=kind)
            for c, limits in enumerate(cuts):
                coded[:, c] = np.searchsorted(limits, x[:, c], side="left")
            yield pa.record_batch(
                [
                    batch.column("row"),
                    pa.array([r.tobytes() for r in coded], pa.binary()),
                    batch.column("label"),
                    batch.column("fold"),
                ],
                names=["row", "bins", "label", "fold"],
            )

    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        vector_to_array(FEATURES).alias("x"),
        F.col(LABEL).cast("double").alias("label"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
    )
    return rows.mapInArrow(run, "row long, bins binary, label double, fold int")


def _columns(table, columns: int, kind: str):
    """Bins, label, fold and row numbers of a batch or table as arrays."""
    joined = b"".join(table.column("bins").to_pylist())
    x = np.frombuffer(joined, dtype=kind).reshape(-1, columns)
    return x, table.column("label").to_numpy(), table.column("fold").to_numpy(), table.column("row").to_numpy()


# ---------------------------------------------------------------- all fits


@dataclass
class Binned:
    """A binned and written table. ``small`` says that it was proven to fit a broadcast."""

    df: DataFrame
    cuts: list[np.ndarray]
    kind: str
    work: Workspace
    small: bool
    rows: int
    # Largest label without its sign.
    largest: float

    @property
    def java(self) -> bool:
        """Whether it is as small with two bytes a bin, as Java has them."""
        return self.small and self.rows * (2 * len(self.cuts) + 20) <= SMALL_BYTES

    def step(self, plan: TreePlan) -> float:
        """The ``grid`` of the sums of a fit."""
        return grid(self.rows, 1.0 if plan.classes else self.largest)


def bin_table(df: DataFrame, work: Workspace, bins: int = 256, fold: str | None = None) -> Binned:
    cuts = learn_cuts(df, bins)
    kind = "uint8" if bins <= 256 else "uint16"
    table = work.store(into_bins(df, cuts, kind, fold), f"binned-{bins}")
    rows, largest = table.agg(F.count(F.lit(1)), F.max(F.abs("label"))).first()
    size = rows * (len(cuts) * np.dtype(kind).itemsize + 20)
    return Binned(table, cuts, kind, work, rows <= SMALL_ROWS and size <= SMALL_BYTES, rows, largest or 0.0)


def _margin_names(width: int) -> list[str]:
    return [f"m{k}" for k in range(width)]


def _held_rows(number: int, plan: TreePlan, label, fold, rows, margins, width: int) -> pa.RecordBatch:
    """What a fit says of the rows of its fold, given their margins."""
    mine = np.flatnonzero(fold == plan.fold) if plan.fold is not None else np.zeros(0, dtype=np.int64)
    return _told_rows(number, plan, label[mine], rows[mine], margins, width)


def _told_rows(number: int, plan: TreePlan, label, rows, margins, width: int) -> pa.RecordBatch:
    filled = np.zeros((len(rows), width))
    filled[:, : plan.width] = margins
    return pa.record_batch(
        [
            pa.array(np.full(len(rows), number, dtype=np.int32)),
            pa.array(rows),
            pa.array(label),
            *[pa.array(filled[:, k]) for k in range(width)],
        ],
        names=["fit", "row", "label", *_margin_names(width)],
    )


def _pack(trees: list, columns: int) -> bytes:
    """Trees as one compressed archive, nodes one after the other.

    Inner nodes have a bin and leaves a value; where the children are follows from the order of the nodes. Gains are
    kept as a sum for each tree and column.
    """
    out, none = io.BytesIO(), np.zeros(0, dtype=np.int32)
    inner = [t["column"] >= 0 for _, _, t in trees]
    small = np.int8 if columns < 128 else np.int32
    np.savez_compressed(
        out,
        sizes=np.array([len(t["column"]) for _, _, t in trees], dtype=np.int32),
        output=np.array([o for o, _, _ in trees], dtype=np.int32),
        number=np.array([n for _, n, _ in trees], dtype=np.int32),
        column=np.concatenate([none, *(t["column"] for _, _, t in trees)]).astype(small),
        bin=np.concatenate([none, *(t["bin"][i] for i, (_, _, t) in zip(inner, trees))]).astype(np.uint16),
        value=np.concatenate([t["value"][~i] for i, (_, _, t) in zip(inner, trees)]),
        gains=np.array([t["gains"] if "gains" in t else gains_by_column(t, columns) for _, _, t in trees]),
    )
    return out.getvalue()


def gains_by_column(tree: dict, columns: int) -> np.ndarray:
    inner = tree["column"] >= 0
    return np.bincount(tree["column"][inner], weights=tree["gain"][inner], minlength=columns)


def _unpack(data: bytes) -> list:
    """(margin, number, tree) of every tree; values of inner nodes are not kept."""
    with np.load(io.BytesIO(data)) as kept:
        found = {k: kept[k] for k in kept.files}
    column, inner = found["column"].astype(np.int32), found["column"] >= 0
    bins, values = np.zeros(len(column), dtype=np.int32), np.zeros((len(column), *found["value"].shape[1:]))
    bins[inner], values[~inner] = found["bin"], found["value"]
    trees, start = [], 0
    for k, size in enumerate(found["sizes"].tolist()):
        mine = slice(start, start + size)
        left = first_children(column[mine])
        tree = {"column": column[mine], "bin": bins[mine], "left": left, "right": np.where(left >= 0, left + 1, -1)}
        trees.append((int(found["output"][k]), int(found["number"][k]), tree | {"value": values[mine], "gains": found["gains"][k]}))
        start += size
    return trees


def _pieces(binned: Binned) -> DataFrame:
    """The table as ``x, label, fold, row`` of some rows each."""
    columns, kind = len(binned.cuts), binned.kind

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            x, label, fold, rows = _columns(pa.Table.from_batches(held), columns, kind)
            parts = (x.T.tobytes(), label.tobytes(), fold.tobytes(), rows.tobytes())
            return pa.record_batch([pa.array([p], pa.binary()) for p in parts], names=["x", "label", "fold", "row"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(start, PIECE_ROWS)
                if held and sum(b.num_rows for b in held) + part.num_rows > PIECE_ROWS:
                    yield packed()
                    held = []
                held.append(part)
        if held:
            yield packed()

    # A table of as many rows was written in as many parts as its source had: a few pieces to a part.
    parts = max(1, -(-binned.rows // PIECE_ROWS))
    return binned.df.coalesce(parts).mapInArrow(pack, "x binary, label binary, fold binary, row binary")


def _send(binned: Binned) -> list:
    """The table as broadcasts of some rows each; the driver holds one of them at a time."""
    context = binned.df.sparkSession.sparkContext
    return [context.broadcast(tuple(map(bytes, r))) for r in _pieces(binned).toLocalIterator(True)]


def _received(sent: list, columns: int, kind: str):
    """Bins (a line per column), label, fold and row numbers of the whole table."""
    x, label, fold, rows = [], [], [], []
    for piece in sent:
        b, l, f, r = piece.value
        x.append(np.frombuffer(b, dtype=kind).reshape(columns, -1))
        label.append(np.frombuffer(l, dtype=float))
        fold.append(np.frombuffer(f, dtype=np.int32))
        rows.append(np.frombuffer(r, dtype=np.int64))
    if not x:
        return np.zeros((columns, 0), dtype=kind), np.zeros(0), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate(x, axis=1), np.concatenate(label), np.concatenate(fold), np.concatenate(rows)


def _in_tasks(binned: Binned, plans: Sequence[TreePlan], keep: bool, gains: bool = False):
    """Fits finished in tasks that all read the broadcast table; a forest's trees are dealt in groups.

    With ``keep`` the trees of every fit come back, with ``gains`` only each tree's gains by column: then a task has one
    tree of a forest.
    """
    spark = binned.df.sparkSession
    columns, width = len(binned.cuts), max(p.width for p in plans)
    # With many fits a task takes a whole one, so that a row has one margin of each.
    whole = not keep and len(plans) >= 2 * spark.sparkContext.defaultParallelism
    jobs: list[Job] = []
    for i, plan in enumerate(plans):
        per = plan.rounds() if plan.boosted or whole else 1
        dealt = [(i, a, min(a + per, plan.rounds()), None) for a in range(0, plan.rounds(), per)]
        if gains and not plan.boosted and not whole:
            dealt = [(i, a, b, k) for _, a, b, _ in dealt for k in range(len(plan.units(a)))]
        jobs += dealt

    def effort(job: Job) -> float:
        plan = plans[job[0]]
        deep = min(plan.max_depth or 30, 10 if plan.max_leaves else 30)
        return (job[2] - job[1]) * deep * (plan.width if plan.boosted else GROUP)

    # Long ones first.
    jobs.sort(key=lambda job: -effort(job))

    def told(job: tuple[int, int], trees: list, held: tuple) -> pa.RecordBatch:
        """What comes back of a fit and its first round: of its trees or of the labels, numbers and margins of held rows."""
        number, first = job
        if gains:
            found = [t["gains"] if "gains" in t else gains_by_column(t, columns) for _, _, t in trees]
            found = pa.array([g.tolist() for g in found], pa.list_(pa.float64()))
            return pa.record_batch([pa.array([number] * len(found), pa.int32()), found], names=["fit", "gains"])
        if keep:
            one = [pa.array([number], pa.int32()), pa.array([first], pa.int32()), pa.array([_pack(trees, columns)])]
            return pa.record_batch(one, names=["fit", "part", "trees"])
        return _told_rows(number, plans[number], *held, width)

    if gains:
        kinds = "fit int, gains array<double>"
    elif keep:
        kinds = "fit int, part int, trees binary"
    else:
        kinds = "fit int, row long, label double, " + ", ".join(f"{m} double" for m in _margin_names(width))
    java = binned.java and grower.loader(spark) is not None
    sent = [grower.send(_pieces(binned), columns, np.dtype(binned.kind).itemsize)] if java else _send(binned)
    tasks = spark.range(0, len(jobs), 1, len(jobs))
    try:
        grown = (_in_java if java else _in_python)(binned, plans, jobs, keep or gains, tasks, sent, told, kinds)
        if gains:
            return [np.array(r["gains"]) for r in grown.collect()]
        table = binned.work.store(grown, f"grown-{uuid.uuid4().hex}")
    finally:
        for piece in sent:
            piece.destroy()
    if keep:
        # The parts of a forest come one after the other.
        found: dict[int, list] = {i: [] for i in range(len(plans))}
        for r in table.orderBy("fit", "part").toLocalIterator():
            found[r["fit"]].append(bytes(r["trees"]))
        return found
    if all(p.boosted for p in plans) or whole:
        return table
    return table.groupBy("fit", "row").agg(F.first("label").alias("label"), *[F.sum(m).alias(m) for m in _margin_names(width)])


# A fit, its first round, the one after its last, and which tree of a round alone.
Job = tuple[int, int, int, int | None]


def _in_python(binned, plans, jobs: Sequence[Job], trees: bool, tasks: DataFrame, sent: list, told, kinds: str) -> DataFrame:
    columns, kind, steps = len(binned.cuts), binned.kind, [binned.step(p) for p in plans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column(0).to_pylist():
                number, first, end, only = jobs[j]
                plan = plans[number]
                x, label, fold, rows = _received(sent, columns, kind)
                found, margins = grow_rounds(plan, x, label, fold, rows, range(first, end), steps[number], trees, only)
                mine = fold == plan.fold if plan.fold is not None else np.zeros(len(fold), dtype=bool)
                yield told((number, first), found, (label[mine], rows[mine], margins))

    return tasks.mapInArrow(run, kinds)


def _in_java(binned, plans, jobs: Sequence[Job], trees: bool, tasks: DataFrame, sent: list, told, kinds: str) -> DataFrame:
    def unset(value: int | None) -> int:
        return -1 if value is None else value

    whole = [
        [p.boosted, p.classes, p.trees, unset(p.max_depth), unset(p.max_leaves), p.min_split, p.min_leaf]
        + [p.root_columns, p.bootstrap, np.uint64(p.seed & 0xFFFFFFFFFFFFFFFF).astype(np.int64)]
        + [p.fold is not None, unset(p.fold), p.width]
        for p in plans
    ]
    real = [[p.rate, p.subsample, p.penalty, p.tree_columns, binned.step(p)] for p in plans]
    numbers = [[i, a, b, unset(only)] for i, a, b, only in jobs]
    bins = [len(c) + 1 for c in binned.cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                job, plan = (r["fit"], r["part"]), plans[r["fit"]]
                if not trees:
                    rows, label = np.frombuffer(r["a"], dtype=np.int64), np.frombuffer(r["b"])
                    yield told(job, [], (label, rows, np.frombuffer(r["c"]).reshape(len(rows), plan.width)))
                    continue
                column, cut = (np.frombuffer(r[k], dtype=np.int32) for k in "ab")
                tree = {"column": column, "bin": cut, "value": np.frombuffer(r["c"]).reshape(len(column), -1)}
                grown.setdefault(job, []).append((r["output"], r["number"], tree | {"gains": np.frombuffer(r["d"])}))
        for job, own in grown.items():
            yield told(job, own, ())

    return grower.grown(tasks, sent[0], whole, real, numbers, _POISSON, bins, GROUP, trees).mapInArrow(run, kinds)


def _by_levels(binned: Binned, plans: Sequence[TreePlan], keep: bool):
    """All fits in lockstep over the distributed table: one job for the open nodes of all trees of a round."""
    work, columns, kind = binned.work, len(binned.cuts), binned.kind
    bins = max(len(c) for c in binned.cuts) + 1
    offsets = np.concatenate([[0], np.cumsum([p.width for p in plans])])
    state, since = binned.df, []
    steps = [binned.step(p) for p in plans]
    kept: dict[int, list] = {i: [] for i in range(len(plans))}

    def arrays(batches: Iterator[pa.RecordBatch], added: list):
        """A partition as arrays, margins with what the trees since they were written add."""
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return None
        table = pa.Table.from_batches(parts)
        x, label, fold, rows = _columns(table, columns, kind)
        if "margins" in table.column_names:
            joined = b"".join(table.column("margins").to_pylist())
            margins = np.frombuffer(joined, dtype=float).reshape(len(x), -1).copy()
        else:
            margins = np.zeros((len(x), offsets[-1]))
        for i, output, number, tree in added:
            _add(plans[i], margins[:, offsets[i] : offsets[i + 1]], x, output, number, tree)
        return x, label, fold, rows, margins

    for number in range(max(p.rounds() for p in plans)):
        units = [(i, t, o) for i, p in enumerate(plans) if number < p.rounds() for t, o in p.units(number)]
        growing = [Growing(plans[i]) for i, _, _ in units]
        added = list(since)
        while any(g.pending for g in growing):
            open_ = [(u, g.arrays(), g.pending) for u, g in enumerate(growing) if g.pending]

            def count(batches, open_=open_, added=added):
                found = arrays(batches, added)
                if found is None:
                    return
                x, label, fold, rows, margins = found
                for u, shape, pending in open_:
                    i, tree, output = units[u]
                    plan = plans[i]
                    sums = gradients(plan, label, margins[:, offsets[i] : offsets[i + 1]], tree, output, rows, steps[i])
                    if plan.fold is not None:
                        sums *= (fold != plan.fold)[:, None]
                    node = route(x, np.zeros(len(x), dtype=np.int64), shape)
                    for some, histogram in node_histograms(x, node, sums, pending, bins):
                        for k, (n, use) in enumerate(zip(some, drawn_columns(plan, tree, some, columns))):
                            # The first column always goes along: it tells the node's sums.
                            which = np.flatnonzero(use | (np.arange(columns) == 0))
                            yield pa.record_batch(
                                [
                                    pa.array(np.full(len(which), u, dtype=np.int32)),
                                    pa.array(np.full(len(which), n, dtype=np.int32)),
                                    pa.array(which.astype(np.int32)),
                                    pa.array([histogram[k, c].tobytes() for c in which], pa.binary()),
                                ],
                                names=["unit", "node", "column", "histogram"],
                            )

            def choose(table: pa.Table) -> pa.Table:
                u, n, c = (table[k][0].as_py() for k in ("unit", "node", "column"))
                i, tree, _ = units[u]
                total = sum(np.frombuffer(h, dtype=float) for h in table["histogram"].to_pylist()).reshape(bins, -1)
                usable = drawn_columns(plans[i], tree, [n], columns)[0, c]
                best = best_bin(total, c, plans[i]) if usable else None
                return pa.table(
                    {
                        "unit": pa.array([u], pa.int32()),
                        "node": pa.array([n], pa.int32()),
                        "column": pa.array([c], pa.int32()),
                        "gain": pa.array([best.gain if best else -1.0]),
                        "bin": pa.array([best.bin if best else 0], pa.int32()),
                        "left": pa.array([best.left.tobytes() if best else b""], pa.binary()),
                        "total": pa.array([total.sum(axis=0).tobytes()], pa.binary()),
                    }
                )

            best = (
                state.mapInArrow(count, "unit int, node int, column int, histogram binary")
                .groupBy("unit", "node", "column")
                .applyInArrow(choose, "unit int, node int, column int, gain double, bin int, left binary, total binary")
                .groupBy("unit", "node")
                .agg(F.max_by(F.struct("gain", "column", "bin", "left", "total"), F.struct("gain", -F.col("column"))).alias("b"))
            )
            found: dict[int, dict[int, Split]] = {}
            totals: dict[int, np.ndarray] = {}
            for r in best.collect():
                b, total = r["b"], np.frombuffer(r["b"]["total"], dtype=float)
                if r["node"] == 0:
                    totals[r["unit"]] = total
                if b["gain"] > 0:
                    left = np.frombuffer(b["left"], dtype=float)
                    found.setdefault(r["unit"], {})[r["node"]] = Split(b["gain"], b["column"], b["bin"], left, total - left)
            for u, _, _ in open_:
                plan = plans[units[u][0]]
                kinds = (plan.width if not plan.boosted else 1) + 2
                growing[u].tell(totals.get(u, np.zeros(kinds)), found.get(u, {}))
        for (i, _, output), g in zip(units, growing):
            done = g.finished()
            since.append((i, output, number, done))
            if keep:
                kept[i].append((output, number, done))
        if number % WRITTEN == WRITTEN - 1:
            state, since = work.store(_with_margins(state, arrays, list(since)), f"margins-{uuid.uuid4().hex}"), []
    if keep:
        # Parts as those of the tasks: a forest's trees in groups, boosting whole.
        per = [max(1, len(kept[i])) if p.boosted else GROUP for i, p in enumerate(plans)]
        return {i: [_pack(t[a : a + per[i]], columns) for a in range(0, len(t), per[i])] for i, t in kept.items()}
    final, width = list(since), max(p.width for p in plans)

    def held(batches):
        found = arrays(batches, final)
        if found is not None:
            _, label, fold, rows, margins = found
            for i, plan in enumerate(plans):
                own = margins[fold == plan.fold, offsets[i] : offsets[i + 1]] if plan.fold is not None else margins[:0, : plan.width]
                yield _held_rows(i, plan, label, fold, rows, own, width)

    names = ", ".join(f"{m} double" for m in _margin_names(width))
    return work.store(state.mapInArrow(held, f"fit int, row long, label double, {names}"), f"held-{uuid.uuid4().hex}")


def _with_margins(state: DataFrame, arrays, added: list) -> DataFrame:
    def run(batches):
        # One batch at a time keeps its other columns beside the new margins.
        for batch in batches:
            found = arrays([batch], added)
            if found is not None:
                own = [batch.column(c) for c in ("row", "bins", "label", "fold")]
                new = pa.array([m.tobytes() for m in found[4]], pa.binary())
                yield pa.record_batch([*own, new], names=["row", "bins", "label", "fold", "margins"])

    return state.mapInArrow(run, "row long, bins binary, label double, fold int, margins binary")


def held_out_predictions(binned: Binned, plans: Sequence[TreePlan]) -> DataFrame:
    """``fit, label, prediction`` of the rows of every fit's own fold; all fits must have as many classes."""
    found = (_in_tasks if binned.small else _by_levels)(binned, plans, False)
    plan = plans[0]
    if not plan.classes:
        shown = F.col("m0") if plan.boosted else F.col("m0") / _trees_of(plans)
    elif plan.width == 1:
        shown = (F.col("m0") > 0).cast("double")
    else:
        margins = F.array(*_margin_names(plan.width))
        shown = (F.array_position(margins, F.array_max(margins)) - 1).cast("double")
    return found.select("fit", "label", shown.alias("prediction"))


def _trees_of(plans: Sequence[TreePlan]):
    return F.element_at(F.array(*[F.lit(float(p.trees)) for p in plans]), F.col("fit") + 1)


def fit_many(binned: Binned, plans: Sequence[TreePlan]) -> list["TreeModel"]:
    """A fit of every plan on all rows of the table."""
    parts = (_in_tasks if binned.small else _by_levels)(binned, plans, True)
    return [TreeModel.of(plan, parts[i], binned.cuts) for i, plan in enumerate(plans)]


def fit_trees(binned: Binned, plan: TreePlan) -> "TreeModel":
    """One fit on all rows of the table."""
    return fit_many(binned, [plan])[0]


def fit_importances(binned: Binned, plan: TreePlan) -> DenseVector:
    """``featureImportances`` of one fit on all rows; its trees do not reach the driver if they grow in tasks."""
    if not binned.small:
        return fit_trees(binned, plan).featureImportances
    return importances(_in_tasks(binned, [plan], False, gains=True), len(binned.cuts))


def importances(gains: Sequence[np.ndarray], columns: int) -> DenseVector:
    """Each tree's gains by column, scaled to one, summed over the trees and scaled to one."""
    total = np.zeros(columns)
    for own in gains:
        total += own / own.sum() if own.sum() > 0 else 0
    return Vectors.dense(total / total.sum() if total.sum() > 0 else total)


# ---------------------------------------------------------------- the model


class TreeModel(JsonStage):
    """``prediction`` from the feature vector and, for classes, ``probability``."""

    @classmethod
    def of(cls, plan: TreePlan, parts: Sequence[bytes], cuts: Sequence[np.ndarray]) -> TreeModel:
        shape = {"boosted": plan.boosted, "classes": plan.classes, "width": plan.width, "columns": len(cuts)}
        return cls(
            parts=[base64.b64encode(p).decode() for p in parts],
            cuts=[c.tolist() for c in cuts],
            rate=plan.rate,
            scale=1 if plan.boosted else 1 / plan.trees,
            **shape,
        )

    def _trees(self) -> Iterator[tuple[int, float, dict[str, np.ndarray]]]:
        """(margin, factor of its values, tree) of one tree after the other."""
        known = self.known
        for part in known["parts"]:
            for output, number, tree in _unpack(base64.b64decode(part)):
                yield output, known["rate"] if known["boosted"] and number else known["scale"], tree

    @property
    def trees(self) -> list[dict[str, np.ndarray]]:
        """Nodes of every tree: column (-1: leaf), cut (left if the value is at most that), left, right, value (of
        leaves), and the tree's gains by column."""
        cuts, out = [np.array(c) for c in self.known["cuts"]], []
        for _, _, tree in self._trees():
            inner = tree["column"] >= 0
            cut = np.zeros(len(inner))
            cut[inner] = [cuts[c][b] for c, b in zip(tree["column"][inner], tree["bin"][inner])]
            out.append(tree | {"cut": cut})
        return out

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name Spark's tree models have
        return importances([t["gains"] for _, _, t in self._trees()], self.known["columns"])

    def _transform(self, df: DataFrame) -> DataFrame:
        known = self.known
        boosted, width, classes = known["boosted"], known["width"], known["classes"]
        rate, scale, cuts = known["rate"], known["scale"], [np.array(c) for c in known["cuts"]]
        sent = [df.sparkSession.sparkContext.broadcast(base64.b64decode(p)) for p in known.pop("parts")]

        @F.pandas_udf("array<double>")
        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            kept, nodes = [], 0
            while len(kept) < len(sent) and nodes <= KEPT_NODES:
                kept.append(_unpack(sent[len(kept)].value))
                nodes += sum(len(tree["column"]) for _, _, tree in kept[-1])
            for x in batches:
                yield _outputs(x, kept)

        def _outputs(x, kept):
            raw = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(cuts)))
            rows = np.array([np.searchsorted(c, raw[:, k], side="left") for k, c in enumerate(cuts)]).reshape(len(cuts), len(raw))
            out = np.zeros((len(raw), width))
            for k, part in enumerate(sent):
                for output, number, tree in kept[k] if k < len(kept) else _unpack(part.value):
                    found = tree["value"][_leaves(tree, rows)] * (rate if boosted and number else scale)
                    if boosted:
                        out[:, output] += found[:, 0]
                    else:
                        out += found
            if classes and boosted:
                if width == 1:
                    p = 1.0 / (1.0 + np.exp(-out[:, 0]))
                    out = np.column_stack([1 - p, p])
                else:
                    powers = np.exp(out - out.max(axis=1, keepdims=True))
                    out = powers / powers.sum(axis=1, keepdims=True)
            elif classes:
                # A tree without rows at hand tells nothing.
                sums = out.sum(axis=1, keepdims=True)
                out = np.divide(out, sums, out=np.full_like(out, 1 / classes), where=sums > 0)
            return pd.Series(list(out))

        scored = df.withColumn("__margins", margins(vector_to_array(FEATURES)))
        if not classes:
            return scored.withColumn("prediction", F.element_at("__margins", 1)).drop("__margins")
        best = F.array_position("__margins", F.array_max("__margins")) - 1
        return (
            scored.withColumn("prediction", best.cast("double"))
            .withColumn("probability", array_to_vector("__margins"))
            .drop("__margins")
        )


class TreeFit(Estimator):
    """Estimator of one plan, on ``features`` and ``__label``."""

    def __init__(self, plan: TreePlan):
        super().__init__()
        self.plan = plan

    def _fit(self, df: DataFrame) -> TreeModel:
        with Workspace(df.sparkSession) as work:
            return fit_trees(bin_table(df, work, self.plan.bins), self.plan)
