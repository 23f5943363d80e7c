"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.llm.quality import spread_join
from tablelearn.session import FittedTable, fit_table

SEED = 11
# Sources' weights are their numbers of documents to this power, unless weights are given.
TEMPERATURE = 0.5
# A larger mean is drawn as a sum of this many parts: Poisson(a + b) = Poisson(a) + Poisson(b).
PART_MEAN = 50.0
TERMS = 160


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in every engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))).cast(
        "double"
    )


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, n, rate: how often a document of each source is to appear on average.

    The mix has ``epochs`` times the documents of the table. A source's share of it
    is its weight over the sum of the weights of the sources that occur; without
    weights they are the counts to the power TEMPERATURE. A source without a given
    weight gets none. A null source counts as the source ''. Counts cover all rows.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        table = counts.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "source string, weight double"
        )
        weighed = counts.join(F.broadcast(table), "source", "left").fillna(0.0, ["weight"])
    # A fixed order of summing keeps the rates the same from run to run.
    totals = weighed.agg(F.sum("n"), F.sum(F.col("weight").cast("decimal(38,12)")).cast("double")).first()
    rows, total = totals[0] or 0, totals[1] or 0.0
    rate = F.lit(rows * epochs) * F.col("weight") / F.lit(total) / F.col("n") if total else F.lit(0.0)
    return weighed.select("source", "n", rate.cast("double").alias("rate"))


def steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, ...: array<double>; rate at most PART_MEAN."""
    # What lies beyond is less than a double holds.
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    term = lambda k: F.exp(k * F.ln(rate) - rate - log_factorial()[k])
    sums = F.aggregate(
        F.transform(F.sequence(F.lit(0), last), term),
        F.array().cast("array<double>"),
        lambda got, m: F.concat(got, F.array(F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit(0.0)) + m)),
    )
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def log_factorial() -> Column:
    return F.lit([math.lgamma(k + 1) for k in range(TERMS + 1)])


def _marked(rows: DataFrame, table: FittedTable, column: str, mark: str) -> DataFrame:
    """Whether ``column`` is in a table of values with their number of rows ``n``."""
    told = table.df.withColumn(mark, F.lit(True))
    if table.small:
        joined = rows.join(F.broadcast(told.drop("n")), column, "left")
    else:
        joined = spread_join(rows, told, column)
    return joined.withColumn(mark, F.coalesce(mark, F.lit(False)))


def _named(docs: DataFrame, key: str, free: str) -> DataFrame:
    """``docs`` with a name per row from which its draws are hashed, in ``<free>name``.

    A key that only one row has is its name. Where rows share a key or have none, the hash of the whole row is added, and
    where rows are equal besides, their number in the table as it is read.
    """
    own, digest, shared, twice = (free + c for c in ("key", "digest", "shared", "twice"))
    hashed = [quoted(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        "*",
        F.monotonically_increasing_id().alias(free + "row"),
        F.coalesce(quoted(key).cast("string"), F.lit("")).alias(own),
        F.xxhash64(*hashed).alias(free + "hash"),
    ).withColumn(digest, F.concat_ws(":", own, free + "hash"))
    count = lambda df, c: fit_table(df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = _marked(rows, count(rows.where(quoted(key).isNotNull()).select(own), own), own, shared)
    marked = marked.withColumn(shared, F.col(shared) | quoted(key).isNull())
    repeated = count(marked.where(F.col(shared)).select(digest), digest)
    marked = _marked(marked, repeated, digest, twice)
    name = (
        F.when(~F.col(shared), F.col(own))
        .when(~F.col(twice), F.col(digest))
        .otherwise(F.concat_ws(":", digest, F.col(free + "row")))
    )
    return marked.withColumn(free + "name", name)


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = SEED,
    key: str = "doc_id",
) -> DataFrame:
    """Every document as often as a Poisson draw says, all shuffled globally.

    The draw inverts the distribution function at a number hashed from the seed
    and the row's name: its key, or where rows share a key or have none, key and whole row. So each row has
    a draw and places of its own that do not depend on partitions or retries; only those of rows that are equal in everything
    depend on how the table is read. Columns of ``docs`` come first, then mix_copy (0, 1,
    ...) and mix_place, a hash of name and copy by which rows are dealt to partitions
    and ordered in them; both get leading underscores until no column of ``docs`` begins like them. The steps
    of the sources are broadcast if they were found small, else joined by shuffle
    with large sources split. An empty table gives no rows.
    """
    free = "mix_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = "_" + free
    many, step = free + "parts", free + "steps"
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    rates = (
        repetition_rates(docs, weights, epochs)
        .withColumn(many, parts)
        .select(F.col("source").alias(free + "source"), "n", many, steps(F.col("rate") / F.col(many)).alias(step))
    )
    fitted = fit_table(rates)
    rows = _named(docs, key, free).withColumn(free + "source", F.coalesce("source", F.lit("")))
    if fitted.small:
        joined = rows.join(fitted.hinted().drop("n"), free + "source")
    else:
        joined = spread_join(rows, fitted.df, free + "source")
    name, count, copy, place = (free + c for c in ("name", "count", "copy", "place"))
    # Part 0 draws from the name alone, further parts from the name and their number.
    draw = lambda j: uniform(name, F.lit(str(seed)), F.when(j > 0, j))
    one = lambda j: F.size(F.filter(step, lambda s: s <= draw(j)))
    drawn = F.aggregate(F.sequence(F.lit(0), F.col(many) - 1), F.lit(0), lambda got, j: got + one(j))
    return (
        joined.withColumn(count, drawn)
        .withColumn(copy, F.explode(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1))))
        .withColumn(place, F.md5(F.concat_ws(":", F.lit(str(seed + 1)), name, F.col(copy))))
        .select(*[quoted(c) for c in docs.columns], copy, place)
        .repartition(place)
        .sortWithinPartitions(place)
    )
