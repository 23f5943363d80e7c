"""Exact ranks, order statistics and cut points without a global sort of rows.

Three tools, by falling cost:

* ``order_statistics`` finds the values at given ranks of a column. Quantile
  sketches narrow each search to a short interval, exact counts finish it.
* ``hash_cuts`` finds, per stratum, the hash below which exactly ``rank`` rows
  lie. Splits and folds then need one comparison per row and no row shuffle.
* ``running_totals`` / ``global_rank`` add up or number the rows of a sorted table:
  range partitions, then offsets from the per-partition totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelearn.functions.columns import as_double, quoted
from tablelearn.session import FittedTable, cut_lineage, fit_table

# ``hash_cuts`` first counts by leading hex digits, as many as bring a bucket
# to this many rows, but at most 16^5 buckets: a million of 10^12 rows each.
BUCKET_ROWS = 65_536
MOST_DIGITS = 5
# Interval size at which ``order_statistics`` stops narrowing and counts values.
EXACT_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000
# Bounds the sketches one task holds at a time.
SKETCHES_PER_SCAN = 64
# ``monotonically_increasing_id`` numbers the rows of a partition in this many bits, below the partition's number.
ROW_BITS = 33


def order_hash(df: DataFrame, keys: Sequence[str] | None, seed: int) -> Column:
    """Seeded md5 of the row key: a shuffled order that any engine can repeat.

    Rows with equal keys get equal hashes.
    """
    return F.md5(F.concat(F.lit(f"{seed}-"), key_text(keys or df.columns)))


def key_text(columns: Sequence[str]) -> Column:
    """The values joined by "-", so that different rows give different texts.

    A "-" or "\\" inside a value is escaped, and a null is the escape "\\0".
    """
    escaped = [F.regexp_replace(quoted(c).cast("string"), r"([\\-])", r"\\$1") for c in columns]
    return F.concat_ws("-", *[F.coalesce(x, F.lit("\\0")) for x in escaped])


@dataclass(frozen=True)
class Bracket:
    """Interval of values known to hold the given ranks of a column."""

    column: str
    ranks: tuple[int, ...]
    below: int
    inside: int
    low: float | None = None
    high: float | None = None

    def settled(self, limit: int) -> bool:
        return self.inside <= limit or (self.low is not None and self.low == self.high)

    def member(self, value: Column) -> Column:
        keep = value.isNotNull()
        if self.low is not None:
            keep = keep & (value >= F.lit(self.low))
        if self.high is not None:
            keep = keep & (value <= F.lit(self.high))
        return keep


@dataclass(frozen=True)
class OrderStatistic:
    """Value at a rank, with how many rows are smaller and how many are equal."""

    value: float
    below: int
    equal: int


def _neighbours(ranks: Sequence[int]) -> list[tuple[int, ...]]:
    """Ranks in runs without gaps: the two sides of one quantile are searched together."""
    runs: list[list[int]] = []
    for r in sorted(set(ranks)):
        if runs and r == runs[-1][-1] + 1:
            runs[-1].append(r)
        else:
            runs.append([r])
    return [tuple(run) for run in runs]


def _narrow(df: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """One round: sketch each interval, then count the shorter one exactly."""
    slack = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, b in enumerate(brackets):
        first, last = ((r - b.below) / b.inside for r in (b.ranks[0], b.ranks[-1]))
        probes = F.array(F.lit(max(0.0, first - slack)), F.lit(min(1.0, last + slack)))
        x = as_double(b.column)
        sketches.append(F.percentile_approx(F.when(b.member(x), x), probes, F.lit(SKETCH_ACCURACY)).alias(f"s{i}"))
    ends = df.agg(*sketches).first()

    counts = []
    for i, b in enumerate(brackets):
        low, high = ends[f"s{i}"]
        x = as_double(b.column)
        counts.append(F.count_if(x < F.lit(low)).alias(f"b{i}"))
        counts.append(F.count_if(x <= F.lit(high)).alias(f"u{i}"))
    seen = df.agg(*counts).first()

    out = []
    for i, b in enumerate(brackets):
        low, high = ends[f"s{i}"]
        below, upto = seen[f"b{i}"], seen[f"u{i}"]
        if below >= b.ranks[0]:  # the sketch overshot: keep the old end
            below, low = b.below, b.low
        if upto < b.ranks[-1]:
            upto, high = b.below + b.inside, b.high
        out.append(Bracket(b.column, b.ranks, below, upto - below, low, high))
    return out


def order_statistics(
    df: DataFrame,
    wanted: dict[str, Sequence[int]],
    counts: dict[str, int],
    limit: int = EXACT_ROWS,
) -> dict[tuple[str, int], OrderStatistic]:
    """Exact values at 1-based ``wanted`` ranks of each column's non-null values.

    ``counts`` holds the number of non-null values per column. Each round reads
    only the columns asked for and cuts the interval by a factor of about 2,500.
    """
    searches: list[Bracket] = []
    for c, ranks in wanted.items():
        if counts[c] > 0 and ranks:
            runs = [tuple(sorted(set(ranks)))] if counts[c] <= limit else _neighbours(ranks)
            searches += [Bracket(c, run, 0, counts[c]) for run in runs]
    stuck: set[Bracket] = set()
    while True:
        open_ones = [b for b in searches if not b.settled(limit) and b not in stuck]
        if not open_ones:
            break
        narrowed: dict[Bracket, Bracket] = {}
        for i in range(0, len(open_ones), SKETCHES_PER_SCAN):
            some = open_ones[i : i + SKETCHES_PER_SCAN]
            narrowed.update(zip(some, _narrow(df, some)))
        searches = [narrowed.get(b, b) for b in searches]
        # Where a round brings nothing, a few hot values fill the interval: the count below settles it.
        stuck |= {n for b, n in narrowed.items() if n.inside >= b.inside}

    if not searches:
        return {}
    hits = [
        F.when(
            b.member(as_double(b.column)),
            F.struct(F.lit(i).alias("q"), as_double(b.column).alias("v")),
        )
        for i, b in enumerate(searches)
    ]
    values = (
        df.select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
        .groupBy("h.q", "h.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    needs = F.element_at(
        F.array(*[F.array(*[F.lit(r - b.below).cast("long") for r in b.ranks]) for b in searches]), F.col("q") + 1
    )
    here = F.filter(needs, lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))
    found = values.withColumn("upto", F.sum("n").over(upto)).select("*", F.explode(here).alias("need")).collect()
    return {
        (searches[r["q"]].column, searches[r["q"]].below + r["need"]): OrderStatistic(
            r["v"], searches[r["q"]].below + r["upto"] - r["n"], r["n"]
        )
        for r in found
    }


def prefix_digits(n: int) -> int:
    return min(MOST_DIGITS, max(1, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16))))


def hash_cuts(df: DataFrame, stratum: Column, hashed: Column, targets: DataFrame, digits: int) -> DataFrame:
    """Per stratum and cut, the hash of the row at the wanted rank.

    ``targets`` has columns ``stratum, cut, rank``; the result has ``stratum,
    cut, threshold, need, equal``: of the ``equal`` rows with this hash the rank
    takes in ``need``. Ranks of zero give the empty string, which no hash
    reaches. ``digits`` comes from ``prefix_digits``. Only counts are shuffled: first per hash prefix, then per hash
    inside the few prefixes that hold a cut.
    """
    rows = df.select(stratum.alias("stratum"), hashed.alias("hash")).withColumn(
        "prefix", F.substring("hash", 1, digits)
    )
    by_prefix = Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        rows.groupBy("stratum", "prefix")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(by_prefix))
    )
    boundary = (
        targets.where("rank > 0")
        .join(histogram, "stratum")
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("stratum", "cut", "prefix", (F.col("rank") - F.col("upto") + F.col("n")).alias("need"))
    )
    edges = fit_table(boundary)
    wanted = edges.df.select("stratum", "prefix").distinct()
    by_hash = Window.partitionBy("stratum", "prefix").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        rows.join(F.broadcast(wanted) if edges.small else wanted, ["stratum", "prefix"], "left_semi")
        .groupBy("stratum", "prefix", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(by_hash))
    )
    found = (
        inside.join(edges.hinted(), ["stratum", "prefix"])
        .where((F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("n")))
        .select(
            "stratum",
            "cut",
            F.col("hash").alias("threshold"),
            (F.col("need") - F.col("upto") + F.col("n")).alias("need"),
            F.col("n").alias("equal"),
        )
    )
    zero = F.lit(0).cast("long")
    none = targets.where("rank <= 0").select(
        "stratum", "cut", F.lit("").alias("threshold"), zero.alias("need"), zero.alias("equal")
    )
    return found.unionByName(none)


def tie_cuts(rows: DataFrame, cuts: FittedTable) -> DataFrame:
    """``stratum, cut, last``: the row number up to which rows with the threshold's hash are taken in.

    ``rows`` has ``stratum, hash, row``; row numbers are unique and come from
    ``monotonically_increasing_id``, whose upper bits number the partitions. Rows are
    counted per partition, then numbered only in the partition that holds the cut,
    so a hash that a third of all rows share is no group in a task.
    """
    keys = ["stratum", "hash"]
    open_cuts = cuts.df.withColumnRenamed("threshold", "hash").where("need > 0 and need < equal")
    wanted = open_cuts.select(*keys).distinct()
    ties = rows.join(F.broadcast(wanted) if cuts.small else wanted, keys, "left_semi").withColumn(
        "block", F.shiftright("row", ROW_BITS)
    )
    order = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = ties.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(order))
    holding = fit_table(
        blocks.join(open_cuts, keys)
        .where((F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("n")))
        .select(*keys, "cut", "block", (F.col("need") - F.col("upto") + F.col("n")).alias("place"))
    )
    inside = Window.partitionBy(*keys, "block").orderBy("row")
    some = holding.df.select(*keys, "block").distinct()
    numbered = ties.join(F.broadcast(some) if holding.small else some, [*keys, "block"], "left_semi").withColumn(
        "place", F.row_number().over(inside)
    )
    return numbered.join(holding.hinted(), [*keys, "block", "place"]).select(
        "stratum", "cut", F.col("row").alias("last")
    )


def running_totals(df: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``before_<value>``: the sum of ``value`` over all rows sorted earlier.

    Rows must be distinct in ``order``. The sorted table is checkpointed, so
    partition numbers and contents cannot change between the two passes.
    """
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    )
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so the unpartitioned window stays small.
    offsets = (
        placed.groupBy("__part")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select("__part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__offset_{v}") for v in values])
    )
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), "__part")
        .select(
            *[F.col(c) for c in df.columns],
            *[
                (F.col(f"__offset_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"before_{v}")
                for v in values
            ],
        )
    )


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Number all rows 1..n by ``order`` (which must be unique per row).

    One shuffle: rows are dealt by range, sorted and numbered where they lie. Row
    numbers carry the partition's number, whose offset is added in place.
    """
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", ROW_BITS))
    )
    place = F.col("__row") - F.shiftleft("__part", ROW_BITS) + 1
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so the unpartitioned window stays small.
    offsets = fit_table(
        placed.groupBy("__part")
        .agg(F.max(place).alias("n"))
        .select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("__offset"))
    )
    return placed.join(offsets.hinted(), "__part").select(
        *[quoted(c) for c in df.columns], (F.col("__offset") + place).alias(name)
    )
