"""Logistic fits of one small table to many folds and penalties at once.

Spark ML runs a job for every step of every fit, which on a small table takes far longer than the step. A table small
enough to be broadcast is sent to the tasks instead, as for trees, and each finishes whole fits by the same steps as Spark's:
the same scaled and centred columns, penalty, start, L-BFGS steps and limits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tablelearn.operators.trees import FEATURES, LABEL
from tablelearn.session import Workspace

# Bytes of a table that may be broadcast, and values of it that pass the driver at a time.
SMALL_BYTES, PIECE_VALUES = 128 << 20, 1 << 19
# Steps whose curvature is kept, and values a fit must have kept to before it counts as done.
KEPT_STEPS, KEPT_VALUES = 10, 20


@dataclass(frozen=True)
class LogisticPlan:
    """One fit, without the rows of its fold."""

    fold: int
    penalty: float
    max_iter: int
    tol: float


class _Failed(Exception):
    """No step could be found."""


Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def objective(x: np.ndarray, label: np.ndarray, classes: int, deviation: np.ndarray, penalty: float) -> Objective:
    """Mean loss and its gradient; ``x`` is scaled, the penalty is that of the unscaled columns.

    Two classes have one line of weights, more have one each; the last weight of a line is the intercept.
    """
    n = len(x)
    shrink = np.append(np.divide(1.0, deviation**2, out=np.zeros_like(deviation), where=deviation > 0), 0.0) * penalty
    own = label.astype(np.int64)

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        weights = flat.reshape(-1, x.shape[1] + 1)
        margins = x @ weights[:, :-1].T + weights[:, -1]
        if len(weights) == 1:
            m = margins[:, 0]
            loss = (np.logaddexp(0.0, m) - own * m).sum()
            slope = (1.0 / (1.0 + np.exp(-m)) - own)[:, None]
        else:
            margins -= margins.max(axis=1, keepdims=True)
            powers = np.exp(margins)
            total = powers.sum(axis=1, keepdims=True)
            loss = (np.log(total[:, 0]) - margins[np.arange(n), own]).sum()
            slope = powers / total
            slope[np.arange(n), own] -= 1.0
        pulled = weights * shrink
        gradient = np.column_stack([slope.T @ x, slope.sum(axis=0)]) / n + pulled
        return float(loss / n + 0.5 * (weights * pulled).sum()), gradient.ravel()

    return value


def _direction(gradient: np.ndarray, steps: list, changes: list) -> np.ndarray:
    out = gradient.copy()
    taken = []
    for step, change in zip(steps, changes):
        rho = step @ change
        share = (step @ out) / rho if rho else np.nan
        if np.isnan(share):
            raise _Failed
        out -= share * change
        taken.append((rho, share))
    if steps:
        curve = steps[0] @ changes[0]
        if not curve >= 0:
            raise _Failed
        out *= curve / (changes[0] @ changes[0])
    for step, change, (rho, share) in reversed(list(zip(steps, changes, taken))):
        out += (share - (change @ out) / rho) * step
    return -out


def _step_size(value: Objective, x: np.ndarray, way: np.ndarray, first: float) -> float:
    """A step that meets the strong Wolfe conditions."""

    def along(t: float) -> tuple[float, float, float]:
        f, g = value(x + t * way)
        return t, f, float(g @ way)

    _, f0, d0 = low = along(0.0)
    if d0 > 0:
        raise _Failed

    def between(low, high) -> float:
        for _ in range(10):
            (a, fa, da), (b, fb, db) = low, high
            d1 = da + db - 3 * (fa - fb) / (a - b)
            d2 = np.sqrt(d1 * d1 - da * db)
            t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
            ends = a + 0.1 * (b - a), a + 0.9 * (b - a)
            t = ends[0] if t < ends[0] else ends[1] if t > ends[1] else t
            now = along(float(t))
            if now[1] > f0 + 1e-4 * now[0] * d0 or now[1] >= low[1]:
                high = now
            else:
                if abs(now[2]) <= 0.9 * abs(d0):
                    return now[0]
                if now[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = now
        raise _Failed

    t = first
    for i in range(10):
        now = along(t)
        if not np.isfinite(now[1]):
            t /= 2
            continue
        if now[1] > f0 + 1e-4 * t * d0 or now[1] >= low[1] and i > 0:
            return between(low, now)
        if abs(now[2]) <= 0.9 * abs(d0):
            return t
        if now[2] >= 0:
            return between(now, low)
        low = now
        t *= 1.5
    raise _Failed


def minimised(value: Objective, start: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Where L-BFGS ends."""
    x = start
    f, g = value(x)
    first, past, steps, changes, done, failed = f, [np.inf], [], [], 0, False
    while done < max_iter:
        if abs(f - max(past)) <= tol * abs(first) or np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        try:
            way = _direction(g, steps, changes)
            size = _step_size(value, x, way, 1.0 if done else 1.0 / np.linalg.norm(way))
            if size * np.linalg.norm(g) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        failed = False
        new = x + size * way
        f, after = value(new)
        steps, changes = [new - x, *steps][:KEPT_STEPS], [after - g, *changes][:KEPT_STEPS]
        x, g, done = new, after, done + 1
        past = [*past, f][-KEPT_VALUES:]
    return x


def fitted_classes(plan: LogisticPlan, x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The predicted class of every row of the plan's fold, by a fit to the other rows."""
    asked, mine = x[fold == plan.fold], fold != plan.fold
    x, label = x[mine], label[mine]
    if not len(x) or not np.isfinite(x).all() or not np.isfinite(label).all():
        raise ValueError("A fit needs rows, and features and labels that are finite numbers")
    counts = np.bincount(label.astype(np.int64)).astype(float)
    if (counts > 0).sum() == 1:
        return np.full(len(asked), float(counts.argmax()))
    centre = x.mean(axis=0)
    deviation = x.std(axis=0, ddof=1)
    # A column of one value has no deviation, whatever its mean was rounded to.
    deviation[(x == x[:1]).all(axis=0)] = 0.0
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    x -= centre
    x *= scale
    lines = len(counts) if len(counts) > 2 else 1
    start = np.zeros((lines, x.shape[1] + 1))
    start[:, -1] = np.log1p(counts) - np.log1p(counts).mean() if lines > 1 else np.log(counts[1] / counts[0])
    found = minimised(objective(x, label, len(counts), deviation, plan.penalty), start.ravel(), plan.max_iter, plan.tol)
    weights = found.reshape(lines, -1)
    margins = ((asked - centre) * scale) @ weights[:, :-1].T + weights[:, -1]
    return (margins[:, 0] > 0).astype(float) if lines == 1 else margins.argmax(axis=1).astype(float)


def is_small(rows: int, columns: int) -> bool:
    """Whether such a table may be broadcast."""
    return 8 * rows * (columns + 2) <= SMALL_BYTES


def held_out_classes(ready: DataFrame, fold: str, rows: int, columns: int, plans: Sequence[LogisticPlan], work: Workspace) -> DataFrame:
    """``fit, label, prediction`` of the rows of every fit's own fold; a task finishes a fit."""
    spark = ready.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = (batch.column(0).flatten(), batch.column(1), batch.column(2))
                packed = [p.to_numpy(zero_copy_only=False).tobytes() for p in parts]
                yield pa.record_batch([pa.array([p], pa.binary()) for p in packed], names=["x", "label", "fold"])

    flat = ready.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double"), F.col(fold).cast("int"))
    parts = flat.coalesce(max(1, -(-rows * columns // PIECE_VALUES)))
    packs = parts.mapInArrow(pack, "x binary, label binary, fold binary")
    sent = [spark.sparkContext.broadcast(tuple(map(bytes, r))) for r in packs.toLocalIterator(True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                x, label, folds = (
                    np.concatenate([np.frombuffer(piece.value[k], dtype=kind) for piece in sent])
                    for k, kind in enumerate((float, float, np.int32))
                )
                plan = plans[number]
                found = fitted_classes(plan, x.reshape(len(label), -1), label, folds)
                held = label[folds == plan.fold]
                yield pa.record_batch(
                    [pa.array(np.full(len(held), number, dtype=np.int32)), pa.array(held), pa.array(found)],
                    names=["fit", "label", "prediction"],
                )

    try:
        found = spark.range(0, len(plans), 1, len(plans)).mapInArrow(run, "fit int, label double, prediction double")
        return work.store(found, f"logistic-{uuid.uuid4().hex}")
    finally:
        for piece in sent:
            piece.destroy()
