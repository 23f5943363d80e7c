"""Logistic fits in tasks: the same as Spark's, in few jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import FLOWERS
from tablelearn.operators import logistic, models
from tablelearn.operators.logistic import LogisticPlan, fitted_classes, held_out_classes
from tablelearn.operators.trees import TreeFit
from tablelearn.plans import search
from tablelearn.plans.search import Candidate, Trainer
from tablelearn.session import Workspace


def rows_of(n, classes, seed):
    """Columns of unlike sizes, the last of one value, and overlapping classes."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 4))
    score = z @ rng.normal(size=(4, classes)) + rng.normal(scale=0.7, size=(n, classes))
    x = np.column_stack([z * [1.0, 10.0, 0.1, 100.0] + [0.0, 5.0, 0.0, 1000.0], np.full(n, 7.3)])
    return x, (score - score.mean(axis=0)).argmax(axis=1).astype(float)


def table(spark, x, y, folds):
    rows = [(Vectors.dense(a.tolist()), float(b), int(f)) for a, b, f in zip(x, y, folds)]
    return spark.createDataFrame(rows, ["features", "__label", "__fold"])


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("penalty", [1e-2, 1e-6])
def test_weights_are_those_of_spark(spark, monkeypatch, classes, penalty):
    x, y = rows_of(400, classes, 3)
    seen = []
    own = logistic.minimised
    monkeypatch.setattr(logistic, "minimised", lambda *a: seen.append(own(*a)) or seen[-1])
    folds = np.arange(400) % 4
    plans = [LogisticPlan(f, penalty, 200, 1e-6) for f in (0, 3)]
    df = table(spark, x, y, folds).cache()
    with Workspace(spark) as work:
        found = held_out_classes(df, "__fold", 400, 5, plans, work).toPandas()
    for k, plan in enumerate(plans):
        fit = LogisticRegression(labelCol="__label", regParam=penalty, standardization=False, maxIter=200, tol=1e-6)
        model = fit.fit(df.where(F.col("__fold") != plan.fold))
        held = model.transform(df.where(F.col("__fold") == plan.fold)).toPandas()
        mine = fitted_classes(plan, x, y, folds)
        assert mine.tolist() == held["prediction"].tolist() and len(set(mine)) == classes
        rows = found[found["fit"] == k]
        assert sorted(zip(rows["label"], rows["prediction"])) == sorted(zip(held["__label"], held["prediction"]))
        deviation = x[folds != plan.fold].std(axis=0, ddof=1)
        weights = seen[-1].reshape(-1, 6)[:, :4] / deviation[:4]
        assert weights == pytest.approx(model.coefficientMatrix.toArray()[:, :4], rel=1e-4, abs=1e-5)


def test_odd_rows():
    x, folds = np.arange(8.0)[:, None], np.arange(8) % 2
    plan = LogisticPlan(0, 0.1, 10, 1e-6)
    assert fitted_classes(plan, x, np.full(8, 2.0), folds).tolist() == [2.0] * 4
    for bad in (np.where(x == 3, np.nan, x), x[folds == 0]):
        with pytest.raises(ValueError):
            fitted_classes(plan, bad, np.arange(len(bad)) % 3 * 1.0, folds[: len(bad)] if len(bad) == 8 else np.zeros(4))


def test_limits():
    assert logistic.is_small(1_000_000, 6) and not logistic.is_small(1_000_000, 100)
    assert models.logistic_plan("regression", "logistic_regression", {}, models.Shape("regression", 9), 0) is None
    plan = models.logistic_plan("classification", "logistic_regression", {"C": 0.5, "max_iter": 7}, models.Shape("classification", 8), 2)
    assert plan == LogisticPlan(2, 0.25, 7, 1e-6)


def test_a_search_takes_few_jobs_and_finds_the_same(spark, flowers, monkeypatch):
    seen = []
    for small in (True, False):
        monkeypatch.setattr(search, "is_small", lambda *a, small=small: small)
        group = f"logistic-{small}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            trainer = Trainer("classification", ["logistic_regression"], n_trials=3, cv_folds=3)
            best = trainer.train(flowers.where("not held"), flowers.where("held"), "target", FLOWERS, ["id"]).best
            scores = search.fold_scores(flowers, "target", FLOWERS, "classification", [best], 3, keys=["id"])
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        seen.append((best.params, best.metrics, scores, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))))
    assert seen[0][:3] == seen[1][:3]
    assert seen[0][3] < 120 < seen[1][3]


def test_trees_of_a_fold_are_refitted_together(flowers):
    ready = search.assemble(flowers, FLOWERS, "target", "classification", [0, 1, 2])
    shape = models.Shape("classification", 150, 3)
    draws = [("random_forest", {"n_estimators": 12}), ("xgboost", {"n_estimators": 4}), ("lightgbm", {"n_estimators": 3, "max_bins": 8})]
    plans = [models.tree_plan("classification", name, params, shape) for name, params in draws]
    for plan, model in zip(plans, search.fit_together(ready, plans)):
        alone = TreeFit(plan).fit(ready)
        assert model.featureImportances == alone.featureImportances
        one, two = (m.transform(ready).select("id", "prediction", "probability").orderBy("id").collect() for m in (model, alone))
        assert one == two
    candidates = [Candidate(name, None, params, {}, 0.0) for name, params in draws]
    together = search.fold_scores(flowers, "target", FLOWERS, "classification", candidates, 2, keys=["id"])
    for c in candidates:
        assert search.fold_scores(flowers, "target", FLOWERS, "classification", [c], 2, keys=["id"])[c.name] == together[c.name]


def test_tables_of_a_large_search_are_fitted_in_the_tasks():
    # Labelled documents of 6 GB: rows to train on, and their columns.
    assert logistic.is_small(890_000, 9) and not logistic.is_small(8_900_000, 9)
