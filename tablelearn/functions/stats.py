"""Column statistics that stay exact and distributed on large tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelearn.functions.columns import as_double, divide, is_number, quoted
from tablelearn.functions.ordering import EXACT_ROWS, order_statistics
from tablelearn.session import fit_table, scratch_path, store

# A variance this small beside the sum of squares may be rounding; such pairs are looked at again.
SUSPECT = 1e-6
# Distinct values are counted exactly up to two to this power.
DISTINCT_BITS = 10
# Columns of a block; wider tables are correlated by pairs of blocks.
BLOCK_COLUMNS = 512
# Texts longer than this many bytes are counted by digest.
LONG_TEXT = 256


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float | None]]:
    """n, mean, population std, min and max of every column in one scan."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = as_double(c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_pop(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        c: {k: row[f"{k}{i}"] for k in ("n", "mean", "std", "min", "max")} for i, c in enumerate(columns)
    }


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    return df.agg(*[F.avg(as_double(c)).alias(c) for c in columns]).first().asDict()


def quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], limit: int = EXACT_ROWS
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between neighbouring values.

    The built-in ``percentile`` keeps every distinct value in one task, so it
    serves only while all columns together hold few of them; longer ones are
    searched.
    """
    if not columns:
        return {}
    counted = df.agg(*[F.count(as_double(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: counted[f"n{i}"] for i, c in enumerate(columns)}
    short = [c for c in columns if sizes[c] * max(1, len(columns) // 4) <= limit]
    out: dict[str, list[float | None]] = {}
    if short:
        probes = F.array(*[F.lit(float(s)) for s in shares])
        row = df.agg(*[F.percentile(as_double(c), probes).alias(f"q{i}") for i, c in enumerate(short)]).first()
        out.update({c: row[f"q{i}"] or [None] * len(shares) for i, c in enumerate(short)})
    long = [c for c in columns if c not in short]
    if long:
        spots = {c: [s * (sizes[c] - 1) for s in shares] for c in long}
        wanted = {
            c: sorted({r for p in spots[c] for r in (int(np.floor(p)) + 1, int(np.ceil(p)) + 1)}) for c in long
        }
        found = order_statistics(df, wanted, sizes, limit)
        for c in long:
            values = []
            for p in spots[c]:
                left = found[c, int(np.floor(p)) + 1].value
                right = found[c, int(np.ceil(p)) + 1].value
                values.append(left + (p - np.floor(p)) * (right - left))
            out[c] = [float(v) for v in values]
    return out


def medians(df: DataFrame, columns: Sequence[str], limit: int = EXACT_ROWS) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, columns, [0.5], limit).items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie.

    Values are counted per (column, value) with map-side partial sums, so
    neither a hot value nor a column of distinct values loads one task. Long
    texts are counted by digest; a second scan then finds the text itself.
    """
    if not columns:
        return {}
    counted = (
        df.select(F.explode(F.array(*[_countable(df, i, c) for i, c in enumerate(columns)])).alias("s"))
        .where("s.whole is not null or s.real is not null or s.text is not null")
        .groupBy("s.col", "s.whole", "s.real", "s.text", "s.digest")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    value = F.struct("whole", "real", "text")
    best = counted.groupBy("col").agg(
        F.min_by(value, F.struct((-F.col("n")).alias("n"), "whole", "real", "text")).alias("v"),
        F.max(F.struct("n", "digest")).alias("top"),
    )
    out: dict[str, object] = dict.fromkeys(columns)
    for row in best.collect():
        name = columns[row["col"]]
        if row["top"]["digest"]:
            out[name] = _long_mode(df, name, counted.where(F.col("col") == row["col"]), row["top"]["n"])
            continue
        v = row["v"]
        picked = v["whole"] if v["whole"] is not None else v["real"] if v["real"] is not None else v["text"]
        out[name] = bool(picked) if isinstance(df.schema[name].dataType, T.BooleanType) else picked
    return out


def _is_long(name: str) -> Column:
    return F.octet_length(quoted(name).cast("string")) > LONG_TEXT


def _short(name: str) -> Column:
    text = quoted(name).cast("string")
    return F.when(_is_long(name), F.md5(text)).otherwise(text)


def _countable(df: DataFrame, i: int, name: str) -> Column:
    """One column's value in the slot of its kind; texts beyond LONG_TEXT as digest."""
    kind = df.schema[name].dataType
    whole = isinstance(kind, (T.IntegralType, T.BooleanType))
    real = is_number(kind) and not whole
    return F.struct(
        F.lit(i).alias("col"),
        (quoted(name).cast("long") if whole else F.lit(None).cast("long")).alias("whole"),
        (as_double(name) if real else F.lit(None).cast("double")).alias("real"),
        (F.lit(None).cast("string") if whole or real else _short(name)).alias("text"),
        (F.lit(False) if whole or real else F.coalesce(_is_long(name), F.lit(False))).alias("digest"),
    )


def _long_mode(df: DataFrame, name: str, counted: DataFrame, most: int) -> str:
    """Smallest text among the most frequent ones, some of which were digested."""
    rows = df.where(quoted(name).isNotNull()).select(
        quoted(name).cast("string").alias("value"), _short(name).alias("text"), _is_long(name).alias("digest")
    )
    if most > 1:  # else every value is among the most frequent
        ties = fit_table(counted.where(F.col("n") == most).select("text", "digest"))
        rows = rows.join(ties.hinted(), ["text", "digest"], "left_semi")
    return rows.agg(F.min("value")).first()[0]


def rows_and_distinct(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and distinct non-null values of every column, in one scan.

    A theta sketch keeps the hashes of the values themselves until it is full, so
    counts up to 2^DISTINCT_BITS are exact and larger ones are estimates. It holds a
    bounded number of hashes per column, whatever the column holds.
    """
    hashed = [F.when(quoted(c).isNotNull(), F.xxhash64(quoted(c))) for c in columns]
    found = [
        F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(h, F.lit(DISTINCT_BITS))), F.lit(0)).alias(f"d{i}")
        for i, h in enumerate(hashed)
    ]
    row = df.agg(F.count(F.lit(1)).alias("n"), *found).first()
    return row["n"], {c: row[f"d{i}"] for i, c in enumerate(columns)}


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values: exact where few, estimated where many.

    Rules that read these counts compare them with 15 or 50, where they are exact.
    """
    return rows_and_distinct(df, columns)[1] if columns else {}


def variances(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Sample variance; None for a column with fewer than two values."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = as_double(c)
        aggs.append(F.when(F.count(x) > 1, F.var_samp(x)).alias(f"v{i}"))
    row = df.agg(*aggs).first()
    return {c: row[f"v{i}"] for i, c in enumerate(columns)}


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_ENDS = ("x0", "x1", "y0", "y1")


def _matrix(batch: pa.RecordBatch, block: range) -> np.ndarray:
    """Values of a block's columns, one row per row; NaN where there is none."""
    return np.asarray(batch.column(f"b{block.start}").flatten()).reshape(batch.num_rows, len(block))


def _column_sums(blocks: list[range]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, blocks[-1].stop))
        for batch in batches:
            for block in blocks:
                x = _matrix(batch, block)
                total[0, block] += (~np.isnan(x)).sum(axis=0)
                total[1, block] += np.nansum(x, axis=0)
        places = pa.array(np.arange(total.shape[1], dtype="int32"))
        yield pa.record_batch([places, pa.array(total[0]), pa.array(total[1])], names=["i", "n", "s"])

    return sums


def _pair_sums(centres: np.ndarray, left: range, right: range):
    def centred(batch: pa.RecordBatch, block: range) -> tuple[np.ndarray, np.ndarray]:
        raw = _matrix(batch, block) - centres[block]
        there = ~np.isnan(raw)
        return np.where(there, raw, 0.0), there.astype("float64")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(left), len(right)))
        for batch in batches:
            x, has_x = centred(batch, left)
            y, has_y = (x, has_x) if left == right else centred(batch, right)
            total += np.stack(
                [has_x.T @ has_y, x.T @ has_y, has_x.T @ y, (x * x).T @ has_y, has_x.T @ (y * y), x.T @ y]
            )
        a, b = np.nonzero(np.asarray(left)[:, None] < np.asarray(right)[None, :])
        places = [pa.array((a + left.start).astype("int32")), pa.array((b + right.start).astype("int32"))]
        yield pa.record_batch([*places, *(pa.array(t[a, b]) for t in total)], names=["i", "j", *_SUMS])

    return sums


def _pair_ranges(pairs: list[tuple[int, int]], left: range, right: range):
    """Least and largest value of both columns of each pair where both are present, per partition."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.tile([np.inf, -np.inf, np.inf, -np.inf], (len(pairs), 1))
        for batch in batches:
            x, y = _matrix(batch, left), _matrix(batch, right)
            for k, (i, j) in enumerate(pairs):
                one, other = x[:, i - left.start], y[:, j - right.start]
                both = ~np.isnan(one) & ~np.isnan(other)
                if both.any():
                    one, other = one[both], other[both]
                    ends[k, ::2] = np.minimum(ends[k, ::2], [one.min(), other.min()])
                    ends[k, 1::2] = np.maximum(ends[k, 1::2], [one.max(), other.max()])
        places = [pa.array(p) for p in np.array(pairs, dtype="int32").T]
        yield pa.record_batch([*places, *(pa.array(e) for e in ends.T)], names=["i", "j", *_ENDS])

    return ranges


def _block_correlations(values: DataFrame, centres: np.ndarray, left: range, right: range) -> DataFrame:
    """i, j, r of the pairs i < j of two blocks of columns."""
    part = values.select(*[f"b{k}" for k in sorted({left.start, right.start})])
    schema = "i int, j int, " + ", ".join(f"{k} double" for k in _SUMS)
    sums = part.mapInArrow(_pair_sums(centres, left, right), schema)
    total = fit_table(sums.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in _SUMS]))
    cov = F.col("sxy") - divide(F.col("sx") * F.col("sy"), F.col("n"))
    vx = F.col("sxx") - divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - divide(F.col("sy") * F.col("sy"), F.col("n"))
    suspect = total.df.where((vx <= SUSPECT * F.col("sxx")) | (vy <= SUSPECT * F.col("syy"))).where("n > 0")
    # At most the pairs of two blocks.
    doubtful = [(r["i"], r["j"]) for r in suspect.select("i", "j").collect()]
    found = total.df.withColumn("flat", F.col("n") <= 0)
    if doubtful:
        schema = "i int, j int, " + ", ".join(f"{k} double" for k in _ENDS)
        ends = (
            part.mapInArrow(_pair_ranges(doubtful, left, right), schema)
            .groupBy("i", "j")
            .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        )
        constant = fit_table(ends.where("x0 >= x1 or y0 >= y1").select("i", "j", F.lit(True).alias("constant")))
        found = found.join(constant.hinted(), ["i", "j"], "left").withColumn(
            "flat", F.col("flat") | F.coalesce("constant", F.lit(False))
        )
    spread = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return found.select("i", "j", F.when(~F.col("flat"), divide(cov, spread)).alias("r"))


def correlations(
    df: DataFrame, columns: Sequence[str], above: float | None = None, block: int = BLOCK_COLUMNS
) -> DataFrame:
    """Pearson r of every column pair: ``i, j, left, right, r`` with i < j.

    With ``above`` only pairs whose absolute r exceeds it. Nulls and NaN are dropped
    pair by pair. A column that is constant where both are present gives NULL: pairs
    whose variance could be rounding are compared by least and largest value.

    Sums come from one matrix product per batch. A table of more than ``block``
    columns is stored once, an array per block of columns; every pair of blocks is then
    a job that reads only these two, over all partitions, and keeps only the pairs
    asked for. So no task holds sums of more than two blocks, however wide the table.
    """
    names = list(columns)
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "i int, j int, left string, right string, r double")
    blocks = [range(k, min(k + block, len(names))) for k in range(0, len(names), block)]
    nan = F.lit(float("nan"))
    values = df.select(
        *[F.array(*[F.coalesce(as_double(names[i]), nan) for i in some]).alias(f"b{some.start}") for some in blocks]
    )
    if len(blocks) > 1:
        values = store(values, "numbers")
    # Centre first: sums of raw squares would lose the digits r depends on.
    centres = np.zeros(len(names))
    column_sums = values.mapInArrow(_column_sums(blocks), "i int, n double, s double")
    # One row per column.
    for row in column_sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").collect():
        centres[row["i"]] = row["s"] / row["n"]
    path = None if len(blocks) == 1 else scratch_path(spark, "correlations")
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            found = _block_correlations(values, centres, left, right)
            if above is not None:
                found = found.where(F.abs("r") > above)
            if path:
                found.write.mode("append").parquet(path)
    if path:
        found = spark.read.parquet(path)
    # One row per column.
    labels = F.broadcast(spark.createDataFrame(list(enumerate(names)), "k int, label string"))
    return (
        found.join(labels.select(F.col("k").alias("i"), F.col("label").alias("left")), "i")
        .join(labels.select(F.col("k").alias("j"), F.col("label").alias("right")), "j")
        .select("i", "j", "left", "right", "r")
    )
