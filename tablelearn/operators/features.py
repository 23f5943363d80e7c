"""Feature stages: Spark ML estimators that learn in aggregates and apply in a projection.

The label stays in the row. Every fitted stage can be saved inside a
``PipelineModel``: scalars travel as one JSON param, dictionaries as Parquet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
)
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelearn.functions import stats
from tablelearn.functions.columns import (
    as_double,
    is_number,
    nan_to_null,
    numeric_columns,
    quoted,
    string_columns,
)
from tablelearn.functions.ordering import global_rank
from tablelearn.session import SMALL_ROWS, FittedTable, fit_table

# Text that stands for a missing value in label encoding and one-hot names.
MISSING_TEXT = "nan"


class JsonStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Transformer whose state is one JSON document."""

    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    def __init__(self, **state: Any):
        super().__init__()
        self._set(state=json.dumps(state))

    @property
    def known(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.state))


class _Learner(Estimator):
    """Estimator over some columns; by default all of its kind but ``exclude``."""

    def __init__(self, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()):
        super().__init__()
        self.columns = list(columns) if columns is not None else None
        self.exclude = list(exclude)


# ---------------------------------------------------------------- missing values


class FillMissing(_Learner):
    """Fill nulls with the mean, median or mode; text always takes the mode.

    Fills are learned for every column asked for, with or without nulls today,
    so later data with new gaps can still be scored.
    """

    def __init__(self, strategy: str = "median", columns=None, exclude=()):
        super().__init__(columns, exclude)
        self.strategy = strategy

    def _fit(self, df: DataFrame) -> FilledMissing:
        df = nan_to_null(df)
        asked = self.columns if self.columns is not None else [c for c in df.columns if c not in self.exclude]
        present = [c for c in asked if c in df.columns]
        numeric = [c for c in present if is_number(df.schema[c].dataType)]
        fills: dict[str, Any] = {}
        if self.strategy == "mean":
            fills.update(stats.means(df, numeric))
        elif self.strategy == "median":
            fills.update(stats.medians(df, numeric))
        fills.update(stats.modes(df, [c for c in present if c not in fills]))
        return FilledMissing(fills={c: v for c, v in fills.items() if v is not None})


class FilledMissing(JsonStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        fills = self.known["fills"]
        df = nan_to_null(df)
        return df.select(
            *[_filled(f, fills[f.name]).alias(f.name) if f.name in fills else quoted(f.name) for f in df.schema]
        )


def _filled(field: T.StructField, fill: Any) -> Column:
    x = quoted(field.name)
    # A fractional mean cannot live in a whole-number column.
    if isinstance(field.dataType, T.IntegralType) and float(fill) != int(fill):
        return F.coalesce(x.cast("double"), F.lit(float(fill)))
    return F.coalesce(x, F.lit(fill).cast(field.dataType))


class DropMissing(JsonStage):
    """Drop rows with a null in the given columns, or in any column."""

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__(columns=list(columns) if columns is not None else None)

    def _transform(self, df: DataFrame) -> DataFrame:
        return nan_to_null(df).dropna(subset=self.known["columns"])


# ---------------------------------------------------------------- encoding


class OneHot(_Learner):
    """One 0/1 column per category, sorted, after the other columns; unseen is all 0.

    Every category becomes a column of the table, so all of them reach the driver.
    """

    def _fit(self, df: DataFrame) -> OneHotApplied:
        columns = self.columns if self.columns is not None else string_columns(df, self.exclude)
        if not columns:
            return OneHotApplied(categories={})
        found = _key_counts(df, columns).collect()
        categories: dict[str, list] = {c: [] for c in columns}
        for row in found:
            categories[columns[row["feature"]]].append(row["key"])
        for c, keys in categories.items():
            number = is_number(df.schema[c].dataType)
            keys.sort(key=lambda k, n=number: (k is None, (float(k) if n else k) if k is not None else 0))
        return OneHotApplied(categories=categories)


class OneHotApplied(JsonStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        categories = self.known["categories"]
        kept = [quoted(c) for c in df.columns if c not in categories]
        flags = []
        for c, keys in categories.items():
            text = quoted(c).cast("string")
            for k in keys:
                hit = text.isNull() if k is None else F.coalesce(text == F.lit(k), F.lit(False))
                flags.append(hit.cast("double").alias(f"{c}_{MISSING_TEXT if k is None else k}"))
        return df.select(*kept, *flags)


def _key_counts(df: DataFrame, columns: Sequence[str], value: Column | None = None) -> DataFrame:
    """Rows per (feature number, key) for all columns in one scan and one shuffle."""
    cells = [F.struct(F.lit(i).alias("feature"), quoted(c).cast("string").alias("key")) for i, c in enumerate(columns)]
    source = [F.explode(F.array(*cells)).alias("c")]
    aggs = [F.count(F.lit(1)).alias("n")]
    if value is not None:
        source.append(value.alias("__y"))
        aggs.append(F.avg("__y").alias("mean"))
    return df.select(*source).groupBy("c.feature", "c.key").agg(*aggs)


class _DictionaryWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table.df.write.parquet(f"{path}/dictionary")


class _DictionaryReader(DefaultParamsReader):
    def load(self, path: str):
        stage = super().load(path)
        stage.table = fit_table(self.sparkSession.read.parquet(f"{path}/dictionary"))
        return stage


class _Dictionary(JsonStage):
    """Stage that replaces columns by a lookup in ``feature, key, n, value``."""

    table: FittedTable

    @classmethod
    def of(cls, table: FittedTable, **state: Any):
        stage = cls(**state)
        stage.table = table
        return stage

    def write(self):
        return _DictionaryWriter(self)

    @classmethod
    def read(cls):
        return _DictionaryReader(cls)

    def _tables(self) -> list[FittedTable]:
        """The dictionary of each column: a small one stays small beside a large one."""
        if self.table.small:
            return [self.table] * len(self.known["columns"])
        if not hasattr(self, "_own"):
            counted = self.table.df.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
            sizes = {r["feature"]: r["n"] for r in counted.collect()}
            self._own = [
                fit_table(self.table.df.where(F.col("feature") == i)) if sizes.get(i, 0) <= SMALL_ROWS else self.table
                for i in range(len(self.known["columns"]))
            ]
        return self._own

    def _replace(self, df: DataFrame, key: Callable[[Column], Column], default: Column) -> DataFrame:
        known = self.known
        order = df.columns
        for i, (c, own) in enumerate(zip(known["columns"], self._tables())):
            entries = own.df.where(F.col("feature") == i).select(
                F.col("key").alias("__key"), F.col("n").alias("__n"), F.col("value").alias("__value")
            )
            df = _lookup(df.withColumn("__key", key(quoted(c).cast("string"))), entries, own.small, known["rows"])
            df = df.withColumn(c, F.coalesce("__value", default)).drop("__key", "__value")
        return df.select(*[quoted(c) for c in order])


def _lookup(df: DataFrame, entries: DataFrame, small: bool, rows: int) -> DataFrame:
    """Left join on ``__key`` that no frequent key can slow down.

    A small dictionary is broadcast. Of a large one only the keys that hold
    more than a thousandth of the rows are (at most 1,000 such keys exist); the
    other keys are joined by shuffle. Rows that need no shuffle join take part
    under a hash of the whole row, which spreads them and matches nothing.
    """
    if small:
        return df.join(F.broadcast(entries.drop("__n")), "__key", "left")
    frequent = entries.where(F.col("__n") * 1000 > rows).select("__key", F.col("__value").alias("__hot"))
    open_one = F.col("__hot").isNull() & F.col("__key").isNotNull()
    spread = F.xxhash64(*[quoted(c) for c in df.columns]).cast("string")
    marked = (
        df.join(F.broadcast(frequent), "__key", "left")
        .withColumn("__open", open_one)
        .withColumn("__probe", F.when(open_one, F.col("__key")).otherwise(spread))
    )
    rest = entries.select(F.col("__key").alias("__probe"), "__value", F.lit(True).alias("__open"))
    return (
        marked.join(rest, ["__probe", "__open"], "left")
        .withColumn("__value", F.coalesce("__hot", "__value"))
        .drop("__probe", "__open", "__hot")
    )


class LabelCodes(_Learner):
    """Replace categories by their rank in code-point order; unseen becomes -1."""

    def _fit(self, df: DataFrame) -> LabelCoded:
        columns = self.columns if self.columns is not None else string_columns(df, self.exclude)
        if not columns:
            return LabelCoded.of(fit_table(_empty_dictionary(df, "long")), columns=[], rows=0)
        keys = fit_table(
            _key_counts(df, columns).select("feature", F.coalesce("key", F.lit(MISSING_TEXT)).alias("key"), "n")
            .groupBy("feature", "key").agg(F.sum("n").alias("n"))
        )
        if keys.small:
            order = Window.partitionBy("feature").orderBy("key")
            coded = keys.df.withColumn("value", (F.row_number().over(order) - 1).cast("long"))
        else:
            ranked = global_rank(keys.df, ["feature", "key"])
            start = ranked.groupBy("feature").agg(F.min("rank").alias("start"))
            coded = ranked.join(F.broadcast(start), "feature").select(
                "feature", "key", "n", (F.col("rank") - F.col("start")).alias("value")
            )
        total = keys.df.where("feature = 0").agg(F.sum("n")).first()[0]
        return LabelCoded.of(fit_table(coded), columns=list(columns), rows=total or 0)


def _empty_dictionary(df: DataFrame, kind: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"feature int, key string, n long, value {kind}")


class LabelCoded(_Dictionary):
    def _transform(self, df: DataFrame) -> DataFrame:
        return self._replace(df, lambda k: F.coalesce(k, F.lit(MISSING_TEXT)), F.lit(-1).cast("long"))


class OneHotVector(_Learner):
    """All categories of all columns as one sparse 0/1 vector, for models; unseen is all 0.

    The columns are replaced by the vector ``out``, whose places follow the columns
    and in each the code-point order of its categories, a missing value being one.
    The categories stay a distributed table, so their number has no limit but the
    size of a vector.
    """

    def __init__(self, columns=None, exclude=(), out: str = "categories"):
        super().__init__(columns, exclude)
        self.out = out

    def _fit(self, df: DataFrame) -> PipelineModel:
        columns = self.columns if self.columns is not None else string_columns(df, self.exclude)
        if not columns:
            return PipelineModel(stages=[])
        coded = LabelCodes(columns).fit(df)
        counted = coded.table.df.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = {columns[r["feature"]]: r["n"] for r in counted}
        parts = [f"{c}_flags" for c in columns]
        # The encoder learns sizes only, which are known: one row holds them.
        last = df.sparkSession.createDataFrame([tuple(float(max(sizes.get(c, 0) - 1, 0)) for c in columns)], list(columns))
        flags = OneHotEncoder(inputCols=list(columns), outputCols=parts, handleInvalid="keep").fit(last)
        vector = VectorAssembler(inputCols=parts, outputCol=self.out)
        return PipelineModel(stages=[coded, UnseenLast(sizes=sizes), flags, vector, Dropped(columns=[*columns, *parts])])


class UnseenLast(JsonStage):
    """Codes of unseen categories become the number of categories, which the encoder leaves out."""

    def _transform(self, df: DataFrame) -> DataFrame:
        sizes = self.known["sizes"]
        return df.withColumns({c: F.when(quoted(c) < 0, F.lit(n)).otherwise(quoted(c)).cast("double") for c, n in sizes.items()})


class Dropped(JsonStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        gone = set(self.known["columns"])
        return df.select(*[quoted(c) for c in df.columns if c not in gone])


class TargetMeans(_Learner):
    """Replace categories by the mean target; unseen and null take the global mean."""

    def __init__(self, target: str, columns=None, exclude=()):
        super().__init__(columns, exclude)
        self.target = target

    def _fit(self, df: DataFrame) -> TargetMeansApplied:
        y = as_double(self.target)
        columns = self.columns if self.columns is not None else string_columns(df, [*self.exclude, self.target])
        overall, rows = df.agg(F.avg(y), F.count(F.lit(1))).first()
        if not columns:
            return TargetMeansApplied.of(fit_table(_empty_dictionary(df, "double")), columns=[], rows=0, mean=overall)
        means = _key_counts(df, columns, y).where("key is not null").withColumnRenamed("mean", "value")
        return TargetMeansApplied.of(fit_table(means), columns=list(columns), rows=rows, mean=overall)


class TargetMeansApplied(_Dictionary):
    def _transform(self, df: DataFrame) -> DataFrame:
        return self._replace(df, lambda k: k, F.lit(self.known["mean"]).cast("double"))


ENCODERS = ("onehot", "onehot_vector", "label", "target")


def encoder(strategy: str = "onehot", target: str | None = None, columns=None, exclude=()) -> Estimator:
    """The encoding stage for a strategy name."""
    if strategy == "onehot":
        return OneHot(columns, exclude)
    if strategy == "onehot_vector":
        return OneHotVector(columns, exclude)
    if strategy == "label":
        return LabelCodes(columns, exclude)
    if strategy == "target":
        if target is None:
            raise ValueError("target column required for target encoding")
        return TargetMeans(target, columns, exclude)
    raise ValueError(f"Unknown encoding strategy: {strategy}")


# ---------------------------------------------------------------- scaling

SCALERS = ("standard", "minmax", "robust")


class Scale(_Learner):
    """(x - centre) / scale with a scale of 1 where the column does not vary.

    standard: mean and population std; minmax: minimum and range; robust:
    median and interquartile range, both exact.
    """

    def __init__(self, strategy: str = "standard", columns=None, exclude=()):
        super().__init__(columns, exclude)
        if strategy not in SCALERS:
            raise ValueError(f"Unknown scaling strategy: {strategy}")
        self.strategy = strategy

    def _fit(self, df: DataFrame) -> Scaled:
        columns = self.columns if self.columns is not None else numeric_columns(df, self.exclude, booleans=True)
        if self.strategy == "robust":
            spread = stats.quantiles(df, columns, [0.25, 0.5, 0.75])
            found = {c: (q[1], q[2] - q[0]) for c, q in spread.items() if q[1] is not None}
        else:
            seen = {c: m for c, m in stats.moments(df, columns).items() if m["n"]}
            if self.strategy == "standard":
                found = {c: _centre_and_spread(m) for c, m in seen.items()}
            else:
                found = {c: (m["min"], m["max"] - m["min"]) for c, m in seen.items()}
        return Scaled(columns={c: [centre, width or 1.0] for c, (centre, width) in found.items()})


def _centre_and_spread(m: dict[str, float]) -> tuple[float, float]:
    """Mean and population std, free of rounding for a constant column."""
    return (m["min"], 0.0) if m["min"] == m["max"] else (m["mean"], m["std"])


class Scaled(JsonStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self.known["columns"]
        return df.select(
            *[
                ((as_double(c) - F.lit(float(columns[c][0]))) / F.lit(float(columns[c][1]))).alias(c)
                if c in columns
                else quoted(c)
                for c in df.columns
            ]
        )


# ---------------------------------------------------------------- stateless


class DatetimeParts(JsonStage):
    """Replace a time column by hour, day, month, dayofweek (Monday 0) and is_weekend."""

    def __init__(self, column: str = ""):
        super().__init__(column=column)

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.known["column"]
        kind = df.schema[c].dataType
        at = F.to_timestamp(quoted(c)) if isinstance(kind, T.StringType) else quoted(c)
        day = F.weekday(at)
        parts = {
            "hour": F.hour(at.cast("timestamp_ntz") if isinstance(kind, T.DateType) else at),
            "day": F.dayofmonth(at),
            "month": F.month(at),
            "dayofweek": day,
            "is_weekend": F.coalesce(day.isin(5, 6), F.lit(False)),
        }
        return df.select(
            *[quoted(x) for x in df.columns if x != c],
            *[v.cast("long").alias(f"{c}_{k}") for k, v in parts.items()],
        )


class Interactions(JsonStage):
    """Add the product ``a_x_b`` of every pair of the given numeric columns."""

    def __init__(self, columns: Sequence[str] = (), degree: int = 2):
        super().__init__(columns=list(columns), degree=degree)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.known["degree"] < 2:
            return df
        numeric = set(numeric_columns(df, booleans=True))
        names = [c for c in self.known["columns"] if c in numeric]
        products = [
            (as_double(a) * as_double(b)).alias(f"{a}_x_{b}") for i, a in enumerate(names) for b in names[i + 1 :]
        ]
        return df.select(*[quoted(c) for c in df.columns], *products)


# ---------------------------------------------------------------- chain


def missing_handler(strategy: str = "median", columns=None, exclude=()):
    """Row dropping for ``drop``, else filling."""
    return DropMissing(columns) if strategy == "drop" else FillMissing(strategy, columns, exclude)


# Step names a chain accepts -> stage factory; extended with ``add_method``.
METHODS: dict[str, Callable[..., Any]] = {
    "handle_missing": lambda target=None, **p: missing_handler(**p),
    "encode_categorical": lambda target=None, **p: encoder(target=target, **p),
    "scale_numeric": lambda target=None, **p: Scale(**p),
    "create_datetime_features": lambda target=None, exclude=(), **p: DatetimeParts(**p),
    "create_interaction_features": lambda target=None, exclude=(), **p: Interactions(**p),
}


def add_method(name: str, factory: Callable[..., Any]) -> None:
    """Make a custom Transformer or Estimator available to chains by name."""
    METHODS[name] = factory


class FeatureChain:
    """Ordered feature steps, fitted and applied as one Spark ML pipeline."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str, dict[str, Any]]] = []
        self.model: PipelineModel | None = None

    def add_step(self, name: str, method: str, **params: Any) -> FeatureChain:
        if method not in METHODS:
            raise ValueError(f"Unknown feature method: {method}")
        self.steps.append((name, method, params))
        return self

    def stages(self, target: str | None = None, exclude: Sequence[str] = ()) -> list:
        """Stages that leave the target and the ``exclude`` columns alone."""
        spared = [*exclude, *([target] if target is not None else [])]
        return [METHODS[m](target=target, **{"exclude": spared, **p}) for _, m, p in self.steps]

    def fit(self, df: DataFrame, target: str | None = None, exclude: Sequence[str] = ()) -> FeatureChain:
        self.model = Pipeline(stages=self.stages(target, exclude)).fit(df)
        return self

    def fit_transform(self, df: DataFrame, target: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
        return self.fit(df, target, exclude).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("Chain must be fitted before transform")
        return self.model.transform(df)

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError("Chain must be fitted before save")
        self.model.write().overwrite().save(str(path))

    @classmethod
    def load(cls, path: str) -> FeatureChain:
        chain = cls()
        chain.model = PipelineModel.load(str(path))
        return chain
