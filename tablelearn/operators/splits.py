"""Splits and folds as a column: one comparison per row against learned cut points.

Membership follows the seeded md5 of the row key, so it is random-like but
repeatable. Fitting a split counts hashes; applying it moves no rows. Only where a
cut falls between rows of one hash (copies of a row) are the rows numbered, and
for that stored once; then as many of them as needed fall on each side.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelearn.functions.columns import is_moment, quoted
from tablelearn.functions.ordering import (
    EXACT_ROWS,
    global_rank,
    hash_cuts,
    order_hash,
    order_statistics,
    prefix_digits,
    running_totals,
    tie_cuts,
)
from tablelearn.functions.stats import distinct_counts
from tablelearn.operators.profile import MANY_CLASSES, is_stratifiable
from tablelearn.session import FittedTable, fit_table, local_table, store

TRAIN, VAL, TEST = "train", "val", "test"
_AFTER_ALL = float(2**63)


def _stratum(column: str | None) -> Column:
    if column is None:
        return F.lit("")
    return F.coalesce(quoted(column).cast("string"), F.lit("nan"))


def _class_counts(df: DataFrame, column: str | None) -> FittedTable:
    counts = df.groupBy(_stratum(column).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return fit_table(counts)


def _allocate(counts: FittedTable, size: str, total: int, name: str) -> FittedTable:
    """Share ``total`` among strata in proportion to ``size``, by largest remainder.

    Equal remainders go to the earlier stratum in name order.
    """
    whole = float(counts.total(size))
    if counts.small:
        rows = counts.local.sort_by("stratum")
        exact = rows[size].to_numpy() / whole * float(total)
        given = np.floor(exact).astype("int64")
        first = np.argsort(given - exact, kind="stable")[: total - int(given.sum())]
        given[first] += 1
        fields = [T.StructField(name, T.LongType())]
        schema = T.StructType([*counts.df.schema.fields, *fields])
        return local_table(counts.df.sparkSession, rows.append_column(name, pa.array(given)), schema)
    exact = F.col(size) / F.lit(whole) * F.lit(float(total))
    shares = counts.df.select("*", F.floor(exact).alias("__base"), (F.floor(exact) - exact).alias("__rest"))
    left = total - shares.agg(F.sum("__base")).first()[0]
    ranked = global_rank(shares, ["__rest", "stratum"], "__place")
    shared = ranked.withColumn(name, (F.col("__base") + (F.col("__place") <= left).cast("int")).cast("long"))
    return fit_table(shared.drop("__base", "__rest", "__place"))


def _check_classes(counts: FittedTable, size: str, held: int) -> None:
    n = counts.total(size)
    if counts.small:
        smallest, classes = pc.min(counts.local[size]).as_py(), counts.local.num_rows
    else:
        smallest, classes = counts.df.agg(F.min(size), F.count(F.lit(1))).first()
    if smallest < 2:
        raise ValueError("the least populated class has only 1 member; stratifying needs 2")
    if min(held, n - held) < classes:
        raise ValueError(f"each part must hold at least as many rows as there are classes ({classes})")


# A stored copy of a table with rows that had to be numbered.
Keep = Callable[[DataFrame, str], DataFrame]
_ROW = "__row_number"


def _numbered(df: DataFrame, keep: Keep) -> DataFrame:
    return keep(df.withColumn(_ROW, F.monotonically_increasing_id()), f"numbered-{uuid.uuid4().hex}")


def _within(hashed: Column, threshold: Column, last: Column | None) -> Column:
    """Whether a row is taken in by a cut; ``last`` is the last row number of a divided hash, else null."""
    if last is None:
        return hashed <= threshold
    return (hashed < threshold) | ((hashed == threshold) & (last.isNull() | (F.col(_ROW) <= last)))


def _apply(
    df: DataFrame, by: str | None, hashed: Column, cuts: DataFrame, names: Sequence, out: str, kind: str, divided: bool
) -> DataFrame:
    """Label each row by the first cut that takes it in.

    ``names[i]`` labels rows up to cut ``i``; the last name takes the rest. ``cuts``
    has ``stratum, cut, threshold`` and ``last``, which matters only if ``divided``.
    """
    columns = [quoted(c) for c in df.columns if c != _ROW]
    if by is None:
        found = {r["cut"]: r for r in cuts.collect()}
        labels = F.lit(names[-1])
        for i in reversed(range(len(names) - 1)):
            last = F.lit(found[i]["last"]).cast("long") if divided else None
            labels = F.when(_within(hashed, F.lit(found[i]["threshold"]), last), F.lit(names[i])).otherwise(labels)
        return df.select(*columns, labels.cast(kind).alias(out))
    wide = cuts.groupBy("stratum").agg(
        *[
            F.max(F.when(F.col("cut") == i, F.col(c))).alias(f"{c}{i}")
            for i in range(len(names) - 1)
            for c in ("threshold", "last")
        ]
    )
    table = fit_table(wide.withColumnRenamed("stratum", "__stratum"))
    labels = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        last = F.col(f"last{i}") if divided else None
        taken = _within(F.col("__hash"), F.col(f"threshold{i}"), last)
        labels = F.when(taken, F.lit(names[i])).otherwise(labels)
    marked = df.withColumn("__stratum", _stratum(by)).withColumn("__hash", hashed)
    # Joined by broadcast when small, else by shuffle; a very large class is
    # then split by adaptive execution, since each stratum has one cut row.
    return marked.join(table.hinted(), "__stratum", "left").select(*columns, labels.cast(kind).alias(out))


def random_split(
    df: DataFrame,
    target: str,
    test_size: float = 0.2,
    val_size: float = 0.1,
    stratify: bool = True,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    out: str = "split",
    keep: Keep = store,
) -> DataFrame:
    """Add ``split`` in {train, val, test}, stratified when the target has classes.

    ``keys`` name a row; without them all columns are hashed. The test
    part has ceil(test_size * n) rows, the validation part its share of the rest.
    """
    by = target if stratify and is_stratifiable(df, target) else None
    hashed = order_hash(df, keys, seed)
    counts = _class_counts(df, by)
    n = counts.total("n")
    if n == 0:
        return df.withColumn(out, F.lit(TRAIN))
    n_test = math.ceil(test_size * n)
    if by is not None:
        _check_classes(counts, "n", n_test)
    kept = _allocate(counts, "n", n - n_test, "kept")
    if val_size > 0 and by is None and stratify and _may_lose_values(df, target, n_test):
        # With fewer rows left, a numeric target may now count as classes.
        part = _cut(df, None, hashed, kept, {"0": F.col("n") - F.col("kept")}, [TEST, TRAIN], out, "string", keep)
        rest = part.where(F.col(out) == TRAIN).drop(out)
        if is_stratifiable(rest, target):
            inner = random_split(rest, target, val_size / (1 - test_size), 0.0, True, seed, keys, out, keep)
            renamed = inner.withColumn(out, F.when(F.col(out) == TEST, VAL).otherwise(TRAIN))
            return part.where(F.col(out) == TEST).unionByName(renamed)
    n_val = math.ceil(val_size / (1 - test_size) * (n - n_test)) if val_size > 0 else 0
    if by is not None and n_val:
        _check_classes(kept, "kept", n_val)
    shares = _allocate(kept, "kept", n - n_test - n_val, "trained")
    ranks = {"0": F.col("n") - F.col("kept"), "1": F.col("n") - F.col("trained")}
    return _cut(df, by, hashed, shares, ranks, [TEST, VAL, TRAIN], out, "string", keep)


def _may_lose_values(df: DataFrame, target: str, removed: int) -> bool:
    """Whether taking ``removed`` rows away could leave fewer than 50 distinct targets.

    Each row takes at most one value with it; a fifth covers the sketch's error.
    """
    return distinct_counts(df, [target])[target] * 0.8 - removed < MANY_CLASSES


def _cut(
    df: DataFrame,
    by: str | None,
    hashed: Column,
    shares: FittedTable,
    ranks: dict[str, Column],
    names: Sequence,
    out: str,
    kind: str,
    keep: Keep,
) -> DataFrame:
    """Turn per-stratum ranks into thresholds and label the rows with them."""
    digits = prefix_digits(shares.total("n"))
    cells = [F.struct(F.lit(int(k)).alias("cut"), r.cast("long").alias("rank")) for k, r in ranks.items()]
    targets = shares.df.select("stratum", F.inline(F.array(*cells)))
    cuts = fit_table(hash_cuts(df, _stratum(by), hashed, F.broadcast(targets) if shares.small else targets, digits))
    if cuts.df.where("need < equal").isEmpty():
        whole = cuts.df.withColumn("last", F.lit(None).cast("long"))
        return _apply(df, by, hashed, whole, names, out, kind, False)
    numbered = _numbered(df, keep)
    rows = numbered.select(_stratum(by).alias("stratum"), hashed.alias("hash"), F.col(_ROW).alias("row"))
    divided = cuts.df.join(tie_cuts(rows, cuts), ["stratum", "cut"], "left")
    return _apply(numbered, by, hashed, divided, names, out, kind, True)


def k_folds(
    df: DataFrame,
    target: str,
    n_folds: int = 5,
    stratify: bool = True,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    out: str = "fold",
    keep: Keep = store,
) -> DataFrame:
    """Add ``fold`` in 0..n_folds-1; sizes, and class counts per fold, differ by at most 1.

    Classes are laid end to end; the position of a class decides which folds get
    its extra rows, so whole folds stay balanced too.
    """
    by = target if stratify and is_stratifiable(df, target) else None
    hashed = order_hash(df, keys, seed)
    counts = _class_counts(df, by)
    if counts.small:
        earlier = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.df.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    else:
        placed = running_totals(counts.df, ["stratum"], ["n"]).withColumnRenamed("before_n", "start")
    # Rows at global position p belong to fold p mod k; count them per class.
    def upto(end: Column, fold: int) -> Column:
        return F.floor((end + (n_folds - 1 - fold)) / n_folds)

    total = F.lit(0).cast("long")
    ranks: dict[str, Column] = {}
    for fold in range(n_folds - 1):
        total = total + upto(F.col("start") + F.col("n"), fold) - upto(F.col("start"), fold)
        ranks[str(fold)] = total
    shares = fit_table(placed)
    return _cut(df, by, hashed, shares, ranks, list(range(n_folds)), out, "int", keep)


def fold_parts(df: DataFrame, n_folds: int, fold: str = "fold"):
    """Training and validation frames of every fold in turn."""
    for i in range(n_folds):
        yield df.where(F.col(fold) != i), df.where(F.col(fold) == i)


@dataclass(frozen=True)
class _Spot:
    """The time at a rank as two numbers, with how many rows are earlier and how many at that time."""

    high: float
    low: float
    below: int
    equal: int

    def earlier(self) -> Column:
        return (F.col("__high") < self.high) | ((F.col("__high") == self.high) & (F.col("__low") < self.low))

    def here(self) -> Column:
        return (F.col("__high") == self.high) & (F.col("__low") == self.low)


def _time_halves(df: DataFrame, time: str) -> tuple[Column, Column]:
    """A time as two doubles in its order, both exact: upper and lower half of a whole number, missing last."""
    kind = df.schema[time].dataType
    if is_moment(kind):
        moment = F.unix_micros(quoted(time).cast("timestamp"))
    elif isinstance(kind, T.StringType):
        moment = F.unix_micros(F.to_timestamp(quoted(time)))
    elif isinstance(kind, T.IntegralType):
        moment = quoted(time).cast("long")
    else:
        return F.coalesce(quoted(time).cast("double"), F.lit(_AFTER_ALL)), F.lit(0.0)
    high = F.coalesce(F.shiftright(moment, 32).cast("double"), F.lit(2.0**31))
    return high, F.coalesce(moment.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), F.lit(0.0))


def _spot(timed: DataFrame, rank: int, n: int, limit: int) -> _Spot:
    upper = order_statistics(timed.select("__high"), {"__high": [rank]}, {"__high": n}, limit)["__high", rank]
    inside = timed.where(F.col("__high") == F.lit(upper.value)).select("__low")
    place = rank - upper.below
    lower = order_statistics(inside, {"__low": [place]}, {"__low": upper.equal}, limit)["__low", place]
    return _Spot(upper.value, lower.value, upper.below + lower.below, lower.equal)


def time_split(
    df: DataFrame,
    time: str,
    test_size: float = 0.2,
    val_size: float = 0.1,
    keys: Sequence[str] | None = None,
    out: str = "split",
    limit: int = EXACT_ROWS,
    keep: Keep = store,
) -> DataFrame:
    """Add ``split`` by position in time order: oldest rows train, newest test.

    Ties are ordered by the md5 of the row key; missing times come last. Exact
    order statistics give the cut points, so the table is never sorted. Whole
    numbers and times are compared exactly, whatever their size.
    """
    high, low = _time_halves(df, time)
    columns = [quoted(c) for c in df.columns]
    marked = df.select(*columns, high.alias("__high"), low.alias("__low"), order_hash(df, keys, 0).alias("__hash"))
    n = df.count()
    ends = {VAL: int(n * (1 - test_size)), TRAIN: int(n * (1 - test_size - val_size))}
    spots = {name: _spot(marked, rank, n, limit) for name, rank in ends.items() if rank > 0}
    edges, divided = {}, False
    for name, spot in spots.items():
        need = ends[name] - spot.below
        if need < spot.equal:
            targets = df.sparkSession.createDataFrame([("", 0, need)], "stratum string, cut int, rank long")
            digits = prefix_digits(spot.equal)
            cut = fit_table(hash_cuts(marked.where(spot.here()), F.lit(""), F.col("__hash"), targets, digits))
            edges[name] = (cut, cut.df.first())
            divided = divided or edges[name][1]["need"] < edges[name][1]["equal"]
    if divided:
        marked = _numbered(marked, keep)
    labels = F.lit(TEST)
    for name, spot in spots.items():
        inside = spot.earlier() | spot.here()
        if name in edges:
            cut, edge = edges[name]
            last = None
            if edge["need"] < edge["equal"]:
                rows = marked.where(spot.here()).select(
                    F.lit("").alias("stratum"), F.col("__hash").alias("hash"), F.col(_ROW).alias("row")
                )
                last = F.lit(tie_cuts(rows, cut).first()["last"])
            inside = spot.earlier() | (spot.here() & _within(F.col("__hash"), F.lit(edge["threshold"]), last))
        labels = F.when(inside, F.lit(name)).otherwise(labels)
    return marked.select(*columns, labels.alias(out))


def split_shapes(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and columns of every part, empty ones included."""
    counted = df.groupBy(quoted(split).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))
    parts = df.sparkSession.createDataFrame([(TRAIN,), (VAL,), (TEST,)], "split string")
    return parts.join(counted, "split", "left").select(
        "split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(len(df.columns) - 1).cast("long").alias("n_columns")
    )
