"""Feature selection: filters on statistics, importances and recursive elimination."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tablelearn.functions import stats
from tablelearn.functions.columns import numeric_columns, quoted
from tablelearn.operators.labels import index_label
from tablelearn.operators.trees import TreePlan, bin_table, fit_importances
from tablelearn.session import Workspace

# Trees grow until their leaves are pure.
IMPORTANCE_TREES = 50
IMPORTANCE_SEED = 42

# Why a column was dropped.
CORRELATED = "Correlated (>{limit}) with {other}"
LOW_VARIANCE = "Variance {value:.6f} < {limit}"
LOW_IMPORTANCE = "Importance rank {rank}/{total}"
ELIMINATED = "RFE ranking {rank}"


@dataclass(frozen=True)
class FeatureReport:
    """Columns kept and dropped, in order, with the reason for each drop."""

    selected: list[str]
    dropped: list[str]
    reasons: dict[str, str] = field(default_factory=dict)

    @property
    def n_selected(self) -> int:
        return len(self.selected)

    @property
    def n_dropped(self) -> int:
        return len(self.dropped)

    def rows(self, df: DataFrame) -> DataFrame:
        """The report as ``feature, selected, reason``."""
        rows = [(c, True, None) for c in self.selected]
        rows += [(c, False, self.reasons.get(c)) for c in self.dropped]
        return df.sparkSession.createDataFrame(rows, "feature string, selected boolean, reason string")


def _features(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    skip = set(exclude)
    return [c for c in df.columns if c not in skip], numeric_columns(df, exclude)


def correlation_filter(df: DataFrame, threshold: float = 0.95, exclude: Sequence[str] = ()) -> FeatureReport:
    """Drop a column whose |r| with any earlier numeric column exceeds the threshold.

    An earlier column counts even if it was itself dropped. The reason names the
    first such column.
    """
    columns, numeric = _features(df, exclude)
    if len(numeric) < 2:
        return FeatureReport(columns, [])
    high = stats.correlations(df, numeric, above=threshold)
    first = {r["j"]: numeric[r["i"]] for r in high.groupBy("j").agg(F.min("i").alias("i")).collect()}
    dropped = [numeric[j] for j in sorted(first)]
    reasons = {numeric[j]: CORRELATED.format(limit=threshold, other=name) for j, name in first.items()}
    return FeatureReport([c for c in columns if c not in reasons], dropped, reasons)


def variance_filter(df: DataFrame, threshold: float = 0.01, exclude: Sequence[str] = ()) -> FeatureReport:
    """Drop numeric columns whose sample variance is below the threshold."""
    columns, numeric = _features(df, exclude)
    found = stats.variances(df, numeric)
    dropped = [c for c in numeric if found[c] is not None and found[c] < threshold]
    reasons = {c: LOW_VARIANCE.format(value=found[c], limit=threshold) for c in dropped}
    return FeatureReport([c for c in columns if c not in reasons], dropped, reasons)


def _weights(rows: DataFrame, model: Estimator | None, classes: int) -> list[float]:
    """Importance of every column of the vectors, by the model or a forest of which only the gains are kept."""
    if model is not None:
        return model.fit(rows).featureImportances.toArray()
    plan = TreePlan(
        boosted=False,
        classes=classes,
        trees=IMPORTANCE_TREES,
        root_columns=classes > 0,
        seed=IMPORTANCE_SEED,
    )
    with Workspace(rows.sparkSession) as work:
        return fit_importances(bin_table(rows, work, plan.bins), plan).toArray()


def _assembled(df: DataFrame, numeric: Sequence[str], target: str, task: str) -> tuple[DataFrame, int]:
    """Vectors with numeric labels, and the number of classes (0 for numbers)."""
    classes: Sequence = ()
    if task == "classification":
        df, classes = index_label(df, target, "__label")
    else:
        df = df.withColumn("__label", quoted(target).cast("double"))
    assembler = VectorAssembler(inputCols=list(numeric), outputCol="features", handleInvalid="error")
    return assembler.transform(df).select("features", "__label"), len(classes)


def importance_filter(
    df: DataFrame,
    target: str,
    model: Estimator | None = None,
    top_k: int | None = None,
    task: str = "classification",
    exclude: Sequence[str] = (),
) -> FeatureReport:
    """Keep the ``top_k`` numeric columns by tree importance, best first.

    Non-numeric columns are kept and come first. ``model`` may be any estimator
    on ``features`` and ``__label`` whose model has ``featureImportances``.
    """
    columns, numeric = _features(df, [*exclude, target])
    if not numeric:
        return FeatureReport(columns, [])
    data, classes = _assembled(df, numeric, target, task)
    weights = _weights(data, model, classes)
    ranked = [numeric[i] for i in sorted(range(len(numeric)), key=lambda i: (-weights[i], i))]
    k = len(ranked) if top_k is None else min(top_k, len(ranked))
    reasons = {c: LOW_IMPORTANCE.format(rank=k + i, total=len(ranked)) for i, c in enumerate(ranked[k:], 1)}
    others = [c for c in columns if c not in set(numeric)]
    return FeatureReport(others + ranked[:k], ranked[k:], reasons)


def recursive_elimination(
    df: DataFrame,
    target: str,
    model: Estimator | None = None,
    min_features: int = 5,
    task: str = "classification",
    exclude: Sequence[str] = (),
    step: int = 1,
) -> FeatureReport:
    """Drop the least important column(s), refit, and repeat down to ``min_features``.

    Columns are assembled once and sliced per round. Reasons carry the ranking:
    2 for the last round's drop, rising for earlier ones.
    """
    columns, numeric = _features(df, [*exclude, target])
    if len(numeric) <= min_features:
        return FeatureReport(columns, [])
    data, classes = _assembled(df, numeric, target, task)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    rounds: list[list[int]] = []
    kept = list(range(len(numeric)))
    try:
        while len(kept) > min_features:
            slicer = VectorSlicer(inputCol="features", outputCol="__kept", indices=kept)
            rows = slicer.transform(data).select(F.col("__kept").alias("features"), "__label")
            weights = _weights(rows, model, classes)
            order = sorted(range(len(kept)), key=lambda i: (weights[i], i))
            gone = [kept[i] for i in order[: min(step, len(kept) - min_features)]]
            rounds.append(gone)
            kept = [i for i in kept if i not in gone]
    finally:
        data.unpersist()
    rank = {i: len(rounds) - r + 1 for r, gone in enumerate(rounds) for i in gone}
    dropped = [c for i, c in enumerate(numeric) if i in rank]
    reasons = {numeric[i]: ELIMINATED.format(rank=r) for i, r in sorted(rank.items())}
    others = [c for c in columns if c not in set(numeric)]
    return FeatureReport(others + [numeric[i] for i in kept], dropped, reasons)


@dataclass(frozen=True)
class Selection:
    """Outcome of the filter chain: final columns and the report of every filter."""

    selected: list[str]
    reports: dict[str, FeatureReport]

    @property
    def n_selected(self) -> int:
        return len(self.selected)


def select_features(
    df: DataFrame,
    target: str,
    correlation_threshold: float = 0.95,
    variance_threshold: float = 0.01,
    top_k: int | None = None,
    task: str = "classification",
    exclude: Sequence[str] = (),
) -> Selection:
    """Correlation filter, then variance filter, then importances if ``top_k`` is set."""
    spared = [*exclude, target]
    reports = {"correlation": correlation_filter(df, correlation_threshold, spared)}
    left = df.select(*[quoted(c) for c in reports["correlation"].selected])
    reports["variance"] = variance_filter(left, variance_threshold)
    selected = reports["variance"].selected
    if top_k:
        rows = df.select(*[quoted(c) for c in [*selected, target]])
        reports["importance"] = importance_filter(rows, target, top_k=top_k, task=task)
        selected = reports["importance"].selected
    return Selection(selected, reports)
