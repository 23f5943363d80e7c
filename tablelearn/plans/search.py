"""Random hyperparameter search with cross-validation over several model families."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import (
    Evaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from tablelearn.functions import metrics
from tablelearn.functions.columns import quoted
from tablelearn.operators.labels import LabelDecode, class_list, index_label
from tablelearn.operators.logistic import LogisticPlan, held_out_classes, is_small
from tablelearn.operators.models import (
    FAMILIES,
    FEATURES,
    LABEL,
    ClassProbabilities,
    Shape,
    estimator,
    logistic_plan,
    sample_params,
    search_space,
    tree_plan,
)
from tablelearn.operators.splits import k_folds
from tablelearn.operators.trees import TreePlan, bin_table, fit_many, fit_trees, held_out_predictions
from tablelearn.session import Workspace

log = logging.getLogger(__name__)
FOLD = "__fold"
# Numbers of a feature table that one task goes through in a step of an optimiser.
TASK_VALUES = 500_000

# Metric name -> name in Spark's evaluators; precision, recall and F1 are class-weighted.
CLASS_SCORES = {"accuracy": "accuracy", "f1": "f1", "precision": "weightedPrecision", "recall": "weightedRecall"}
REGRESSION_SCORES = {"r2": "r2", "mae": "mae", "mse": "mse", "rmse": "rmse"}


def scorer(task: str, metric: str) -> Evaluator:
    """Evaluator for a metric name; it knows whether larger is better."""
    if task == "classification":
        if metric not in CLASS_SCORES:
            raise ValueError(f"Unknown classification metric: {metric}")
        return MulticlassClassificationEvaluator(labelCol=LABEL, metricName=CLASS_SCORES[metric])
    if metric not in REGRESSION_SCORES:
        raise ValueError(f"Unknown regression metric: {metric}")
    return RegressionEvaluator(labelCol=LABEL, metricName=REGRESSION_SCORES[metric])


@dataclass(frozen=True)
class Candidate:
    """A fitted model with how it was found and how it did on validation rows."""

    name: str
    model: PipelineModel
    params: dict[str, Any]
    metrics: dict[str, float]
    training_time: float
    folds_scored: int = 0


@dataclass(frozen=True)
class TrainResult:
    candidates: list[Candidate]
    metric: str
    training_time: float
    classes: list | None = None
    columns: list[str] = field(default_factory=list)

    @property
    def best(self) -> Candidate:
        return self.candidates[0]

    @property
    def ranking(self) -> list[str]:
        return [c.name for c in self.candidates]


def assemble(df: DataFrame, columns: Sequence[str], target: str, task: str, classes: Sequence | None) -> DataFrame:
    """Feature vector and numeric label beside the other columns.

    Raises on a null feature: missing values are to be filled before.
    """
    if task == "classification":
        df, _ = index_label(df, target, LABEL, classes)
    else:
        df = df.withColumn(LABEL, quoted(target).cast("double"))
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(df)


def finished(model: Model, columns: Sequence[str], classes: Sequence | None, kind: str | None) -> PipelineModel:
    """Model from feature columns to predicted labels (and class probabilities)."""
    stages: list = [VectorAssembler(inputCols=list(columns), outputCol=FEATURES), model]
    if classes is not None:
        stages += [ClassProbabilities(), LabelDecode(classes, kind)]
    return PipelineModel(stages=stages)


def predict(model: PipelineModel, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Input columns, ``prediction`` and, for classifiers, ``probabilities``."""
    scored = model.transform(df)
    kept = [c for c in (*df.columns, "prediction", "probabilities", *extra) if c in scored.columns]
    return scored.select(*[quoted(c) for c in dict.fromkeys(kept)])


def validation_metrics(df: DataFrame, target: str, task: str) -> dict[str, float]:
    """accuracy and f1, or mae, mse, rmse and r2, of a predictions table."""
    if task == "classification":
        row = metrics.classification_wide(df, target, "prediction").first()
        names = ("accuracy", "f1")
    else:
        row = metrics.regression_wide(df, target, "prediction").first()
        names = ("mae", "mse", "rmse", "r2")
    return {n: row[n] for n in names if row is not None and row[n] is not None}


class Trainer:
    """Train families one after the other; each search runs its fits in parallel.

    The feature vectors are computed once and kept, spilling to disk, for all
    fits of all families.
    """

    def __init__(
        self,
        task: str = "classification",
        models: Sequence[str] | None = None,
        n_trials: int = 10,
        cv_folds: int = 5,
        metric: str | None = None,
        seed: int = 42,
        parallelism: int = 2,
        spaces: Mapping[str, dict[str, Any]] | None = None,
        on_trained: Callable[[Candidate], None] | None = None,
    ):
        if task not in FAMILIES:
            raise ValueError(f"task_type must be classification or regression, got {task}")
        self.task = task
        self.models = list(models or FAMILIES[task])
        self.n_trials = n_trials
        self.cv_folds = cv_folds
        self.metric = metric or ("f1" if task == "classification" else "r2")
        self.seed = seed
        self.parallelism = parallelism
        self.spaces = dict(spaces or {})
        self.on_trained = on_trained

    def train(
        self,
        train: DataFrame,
        validation: DataFrame,
        target: str,
        columns: Sequence[str],
        keys: Sequence[str] | None = None,
        classes: Sequence | None = None,
    ) -> TrainResult:
        """Candidates sorted by the metric on ``validation``, best first.

        A family that fails is left out with a warning; if all fail, RuntimeError.
        """
        start = time.time()
        kind = train.schema[target].dataType.simpleString()
        if self.task == "classification" and classes is None:
            classes = class_list(train, target)
        identity = list(keys) if keys else [*columns, target]
        folded = k_folds(train, target, self.cv_folds, self.task == "classification", self.seed, identity, FOLD)
        ready = assemble(folded, columns, target, self.task, classes).select(FEATURES, LABEL, FOLD)
        ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
        found: list[Candidate] = []
        try:
            shape = Shape(self.task, ready.count(), len(classes or ()), self.seed)
            for name in self.models:
                try:
                    candidate = self._one(name, ready, shape, validation, target, columns, classes, kind)
                except Exception as error:
                    log.warning("training %s failed: %s", name, error)
                    continue
                found.append(candidate)
                if self.on_trained is not None:
                    self.on_trained(candidate)
        finally:
            ready.unpersist()
        if not found:
            raise RuntimeError("All model trainings failed")
        lower = self.metric in metrics.LOWER_IS_BETTER
        found.sort(key=lambda c: c.metrics.get(self.metric, 0.0), reverse=not lower)
        known = list(classes) if classes is not None else None
        return TrainResult(found, self.metric, time.time() - start, known, list(columns))

    def _one(self, name, ready, shape, validation, target, columns, classes, kind) -> Candidate:
        start = time.time()
        space = search_space(self.task, name, self.spaces)
        if space:
            params, fitted = self._search(name, space, ready, shape)
        else:
            params, fitted = {}, estimator(self.task, name, {}, shape).fit(ready)
        model = finished(fitted, columns, classes, kind)
        scores = validation_metrics(predict(model, validation), target, self.task)
        return Candidate(name, model, params, scores, time.time() - start)

    def _search(self, name: str, space, ready: DataFrame, shape: Shape) -> tuple[dict[str, Any], Model]:
        """Best draw by its mean score over the folds, and a fit of it on all rows.

        Every fit knows its own number of rows, which the penalty of a family may depend on.
        """
        draws = sample_params(space, self.n_trials, self.seed)
        judge = scorer(self.task, self.metric)
        plans = [tree_plan(self.task, name, params, shape) for params in draws]
        if all(p is not None for p in plans):
            return self._search_trees(draws, plans, ready, judge.isLargerBetter())
        sizes = {r[FOLD]: r["count"] for r in ready.groupBy(FOLD).count().collect()}
        few, at_once = few_parts(ready, shape.rows, self.parallelism)
        folds = sorted(sizes)
        better = max if judge.isLargerBetter() else min

        def fold_shape(fold: int) -> Shape:
            return replace(shape, rows=shape.rows - sizes[fold])

        def best_of(scores: Sequence[float]) -> tuple[dict[str, Any], Model]:
            means = [sum(scores[i : i + len(folds)]) / len(folds) for i in range(0, len(scores), len(folds))]
            best = draws[means.index(better(means))]
            return best, estimator(self.task, name, best, shape).fit(few)

        fits = [logistic_plan(self.task, name, p, fold_shape(f), f) for p in draws for f in folds]
        one = ready.select(FEATURES).first()
        if one is not None and all(p is not None for p in fits) and is_small(shape.rows, one[0].size):
            with Workspace(ready.sparkSession) as work:
                found = held_out_classes(ready, FOLD, shape.rows, one[0].size, fits, work)
                scores = plan_scores(found, self.task, self.metric)
            return best_of([scores[k] or 0.0 for k in range(len(fits))])

        def score(job: tuple[dict[str, Any], int]) -> float:
            params, fold = job
            model = estimator(self.task, name, params, fold_shape(fold)).fit(few.where(F.col(FOLD) != fold))
            return judge.evaluate(model.transform(few.where(F.col(FOLD) == fold)))

        return best_of(in_parallel(score, [(p, f) for p in draws for f in folds], at_once, ready.sparkSession))

    def _search_trees(
        self, draws: list[dict[str, Any]], plans: list[TreePlan], ready: DataFrame, larger: bool
    ) -> tuple[dict[str, Any], Model]:
        """The same for trees: the columns are binned once, and all draws are fitted to all folds together."""
        with Workspace(ready.sparkSession) as work:
            binned = {b: bin_table(ready, work, b, FOLD) for b in {p.bins for p in plans}}
            folds = [r[FOLD] for r in ready.select(FOLD).distinct().collect()]
            means: list[float] = [0.0] * len(plans)
            for bins, table in binned.items():
                mine = [i for i, p in enumerate(plans) if p.bins == bins]
                fits = [(i, f) for i in mine for f in folds]
                found = held_out_predictions(table, [replace(plans[i], fold=f) for i, f in fits])
                scores = plan_scores(found, self.task, self.metric)
                for k, (i, _) in enumerate(fits):
                    means[i] += (scores[k] or 0.0) / len(folds)
            best = means.index((max if larger else min)(means))
            return draws[best], fit_trees(binned[plans[best].bins], plans[best])


def fit_together(ready: DataFrame, plans: Sequence[TreePlan]) -> list[Model]:
    """A fit of every plan on all rows; plans of as many bins share the binned table and a job."""
    with Workspace(ready.sparkSession) as work:
        models: dict[int, Model] = {}
        for bins in {p.bins for p in plans}:
            mine = [k for k, p in enumerate(plans) if p.bins == bins]
            models |= zip(mine, fit_many(bin_table(ready, work, bins), [plans[k] for k in mine]))
    return [models[k] for k in range(len(plans))]


def plan_scores(found: DataFrame, task: str, metric: str) -> dict[int, float]:
    """The metric of every fit, from ``fit, label, prediction``, in one pass."""
    if task == "classification":
        wide = metrics.classification_wide(found, "label", "prediction", ["fit"])
    else:
        wide = metrics.regression_wide(found, "label", "prediction", ["fit"])
    return {r["fit"]: r["score"] for r in wide.select("fit", F.col(metric).alias("score")).collect()}


def few_parts(ready: DataFrame, rows: int, parallelism: int) -> tuple[DataFrame, int]:
    """The table in as few parts as its size asks for, and how many fits of it fill the cluster (at least ``parallelism``).

    An optimiser runs a job per step, whose time is that of its tasks' start if the table is small.
    """
    one = ready.select(FEATURES).first()
    parts = max(1, -(-rows * (one[0].size if one else 1) // TASK_VALUES))
    cores = ready.sparkSession.sparkContext.defaultParallelism
    return ready.coalesce(parts), max(parallelism, cores // parts)


def in_parallel(work: Callable, jobs: Sequence, parallelism: int, spark: SparkSession) -> list:
    """Results in the order of the jobs, of which so many run at a time."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), jobs)


def results_table(result: TrainResult, df: DataFrame) -> DataFrame:
    """``position, model, metric, value, training_time`` of every candidate."""
    rows = [
        (i, c.name, m, float(v), float(c.training_time))
        for i, c in enumerate(result.candidates, 1)
        for m, v in c.metrics.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, model string, metric string, value double, training_time double"
    )


def fold_scores(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    task: str,
    candidates: Sequence[Candidate],
    n_folds: int = 5,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    classes: Sequence | None = None,
    parallelism: int = 2,
) -> dict[str, list[float]]:
    """Score of a refit per candidate and fold: weighted F1 for classes, r2 for numbers.

    All candidates share the folds and the assembled vectors, those of trees the bins
    of a fold too, and the predictions of all refits are stacked and measured in one pass.
    """
    folds = min(n_folds, df.count())
    if folds < 2 or not candidates:
        return {c.name: [] for c in candidates}
    if task == "classification" and classes is None:
        classes = class_list(df, target)
    identity = list(keys) if keys else [*columns, target]
    parts = k_folds(df, target, folds, task == "classification", seed, identity, FOLD)
    ready = assemble(parts, columns, target, task, classes).select(FEATURES, LABEL, FOLD)
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r[FOLD]: r["count"] for r in ready.groupBy(FOLD).count().collect()}
        rows = sum(sizes.values())
        few, at_once = few_parts(ready, rows, parallelism)
        width = ready.select(FEATURES).first()[0].size
        shapes = [Shape(task, rows - sizes.get(i, 0), len(classes or ()), seed) for i in range(folds)]

        def refit(job: tuple[int, list[Candidate]]) -> list[DataFrame]:
            i, some = job
            plans = [tree_plan(task, c.name, c.params, shapes[i]) for c in some]
            if plans[0] is None:
                models = [estimator(task, c.name, c.params, shapes[i]).fit(few.where(F.col(FOLD) != i)) for c in some]
            else:
                # The draws of trees depend on where the rows lie.
                models = fit_together(ready.where(F.col(FOLD) != i), plans)
            held = few.where(F.col(FOLD) == i)
            scored = [m.transform(held) for m in models]
            return [s.select(F.lit(c.name).alias("model"), FOLD, LABEL, "prediction") for c, s in zip(some, scored)]

        def at_once_refitted(c: Candidate, plans: list[LogisticPlan], work: Workspace) -> list[DataFrame]:
            found = held_out_classes(ready, FOLD, rows, width, plans, work)
            return [found.select(F.lit(c.name).alias("model"), F.col("fit").alias(FOLD), F.col("label").alias(LABEL), "prediction")]

        with Workspace(df.sparkSession) as work:
            jobs: list[Callable[[], list[DataFrame]]] = []
            grown = [c for c in candidates if tree_plan(task, c.name, c.params, shapes[0]) is not None]
            for c in candidates:
                plans = [logistic_plan(task, c.name, c.params, shape, i) for i, shape in enumerate(shapes)]
                if all(p is not None for p in plans) and is_small(rows, width):
                    jobs.append(partial(at_once_refitted, c, plans, work))
                elif c not in grown:
                    jobs += [partial(refit, (i, [c])) for i in range(folds)]
            if grown:
                jobs += [partial(refit, (i, grown)) for i in range(folds)]
            scored = [one for many in in_parallel(lambda job: job(), jobs, at_once, df.sparkSession) for one in many]
            stacked = reduce(DataFrame.unionByName, scored)
            if task == "classification":
                wide = metrics.classification_wide(stacked, LABEL, "prediction", ["model", FOLD])
                wide = wide.select("model", FOLD, F.col("f1").alias("score"))
            else:
                wide = metrics.regression_wide(stacked, LABEL, "prediction", ["model", FOLD])
                wide = wide.select("model", FOLD, F.col("r2").alias("score"))
            out: dict[str, list[float]] = {c.name: [] for c in candidates}
            for r in wide.orderBy("model", FOLD).collect():
                out[r["model"]].append(r["score"])
            return out
    finally:
        ready.unpersist()
