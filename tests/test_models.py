import numpy as np
import pytest
from conftest import FLOWERS
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.sql import functions as F

from tablelearn.operators import models
from tablelearn.operators.labels import LabelDecode, class_list, index_label
from tablelearn.plans import search
from tablelearn.plans.search import Trainer, predict

SMALL = {
    "random_forest": {"n_estimators": [5, 10], "max_depth": [3, None], "min_samples_split": [2], "min_samples_leaf": [1]},
    "xgboost": {"n_estimators": [3], "max_depth": [3], "learning_rate": models.Uniform(0.1, 0.2)},
    "lightgbm": {"n_estimators": [3], "num_leaves": models.Whole(4, 9)},
}


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 3))
    y = 3 * x[:, 0] + 2 * x[:, 1] + rng.normal(scale=0.5, size=200)
    rows = [tuple(float(v) for v in r) + (float(t), i % 5 == 0) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "x1 double, x2 double, x3 double, target double, held boolean").cache()


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "y string")
    assert class_list(df, "y") == ["a", "b"]
    numbers = spark.createDataFrame([(10,), (9,)], "y int")
    indexed, classes = index_label(numbers, "y")
    assert classes == [9, 10] and sorted(r["__label"] for r in indexed.collect()) == [0.0, 1.0]
    coded = spark.createDataFrame([(1.0,), (0.0,)], "prediction double")
    assert [r[0] for r in LabelDecode([9, 10], "int").transform(coded).collect()] == [10, 9]


def test_sampling():
    space = models.search_space("classification", "xgboost")
    draws = models.sample_params(space, 30, 7)
    assert draws == models.sample_params(space, 30, 7) != models.sample_params(space, 30, 8)
    assert all(50 <= d["n_estimators"] < 300 and 3 <= d["max_depth"] < 10 for d in draws)
    assert all(0.01 <= d["learning_rate"] < 0.31 and 0.6 <= d["subsample"] < 1.0 for d in draws)
    assert len(models.sample_params({"a": [1, 2]}, 10, 0)) == 2


def test_spaces():
    custom = {"random_forest": {"n_estimators": [5]}, "mine": {"a": [1]}}
    assert models.search_space("regression", "random_forest", custom) == {"n_estimators": [5]}
    assert models.search_space("regression", "linear_regression") == {}
    assert models.search_space("regression", "never_heard") == {}
    assert set(models.all_spaces("regression", custom)) == {*models.SPACES["regression"], "mine"}


def test_parameter_mapping():
    shape = models.Shape("classification", 100, 2)
    logistic = models.logistic({"C": 0.5, "max_iter": 500}, shape)
    assert logistic.getRegParam() == pytest.approx(1 / 50) and logistic.getMaxIter() == 500
    plan = models.forest({"max_depth": None, "min_samples_split": 7, "min_samples_leaf": 3}, shape).plan
    assert (plan.max_depth, plan.min_split, plan.min_leaf, plan.classes, plan.root_columns) == (None, 7, 3, 2, True)
    plan = models.boosted_by_leaves({"max_depth": 9, "num_leaves": 20, "subsample": 0.7}, shape).plan
    assert (plan.max_depth, plan.max_leaves, plan.subsample) == (9, 20, 0.7)
    plan = models.boosted_by_depth({"colsample_bytree": 0.75, "learning_rate": 0.05}, shape).plan
    assert (plan.tree_columns, plan.rate, plan.max_leaves) == (0.75, 0.05, None)
    numbers = models.forest({}, models.Shape("regression", 100)).plan
    assert (numbers.classes, numbers.root_columns) == (0, False)
    with pytest.raises(ValueError):
        models.estimator("classification", "guess", {}, shape)


def test_classifiers(flowers):
    trainer = Trainer("classification", None, n_trials=2, cv_folds=2, spaces=SMALL)
    result = trainer.train(flowers.where("not held"), flowers.where("held"), "target", FLOWERS)
    assert set(result.ranking) == set(models.FAMILIES["classification"])
    assert result.best.metrics["accuracy"] > 0.7 and result.best.metrics["f1"] > 0.5
    f1 = [c.metrics["f1"] for c in result.candidates]
    assert f1 == sorted(f1, reverse=True) and all(c.training_time > 0 for c in result.candidates)
    for c in result.candidates:
        scored = predict(c.model, flowers.where("held"))
        assert dict(scored.dtypes)["prediction"] == "int"
        sums = scored.select(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x).alias("s"))
        assert all(r["s"] == pytest.approx(1.0) for r in sums.collect())


def test_models_survive_storage(flowers, tmp_path):
    trainer = Trainer("classification", ["xgboost"], n_trials=1, cv_folds=2, spaces=SMALL)
    model = trainer.train(flowers.where("not held"), flowers.where("held"), "target", FLOWERS).best.model
    model.write().save(str(tmp_path / "m"))
    one, two = (predict(m, flowers).select("id", "prediction") for m in (model, PipelineModel.load(str(tmp_path / "m"))))
    assert one.exceptAll(two).count() == 0


def test_regressors(line):
    trainer = Trainer("regression", ["linear_regression", "random_forest"], n_trials=1, cv_folds=2, spaces=SMALL)
    result = trainer.train(line.where("not held"), line.where("held"), "target", ["x1", "x2", "x3"])
    assert result.ranking[0] == "linear_regression" and result.best.metrics["r2"] > 0.9 and result.best.params == {}
    weights = result.best.model.stages[1].coefficients
    assert weights[0] == pytest.approx(3, abs=0.2) and weights[1] == pytest.approx(2, abs=0.2)
    assert set(result.best.metrics) == {"mae", "mse", "rmse", "r2"}


def test_lower_is_better(line):
    trainer = Trainer("regression", ["random_forest", "linear_regression"], 1, 2, "mae", spaces=SMALL)
    result = trainer.train(line.where("not held"), line.where("held"), "target", ["x1", "x2", "x3"])
    assert result.ranking[0] == "linear_regression"
    table = search.results_table(result, line).collect()
    assert {r["position"] for r in table} == {1, 2} and len(table) == 8


def test_failures(flowers, line, caplog):
    with pytest.raises(ValueError):
        Trainer("clustering")
    with pytest.raises(RuntimeError):
        Trainer("classification", ["never_heard"], 1, 2).train(flowers, flowers, "target", FLOWERS)
    some = Trainer("regression", ["never_heard", "linear_regression"], 1, 2)
    assert some.train(line, line, "target", ["x1"]).ranking == ["linear_regression"]
    with pytest.raises(ValueError):
        search.scorer("regression", "f1")
    with pytest.raises(ValueError):
        search.scorer("classification", "mae")


def test_new_family(flowers):
    models.add_family("classification", "bayes", lambda p, s: NaiveBayes(labelCol="__label", **p), {"smoothing": [0.5, 1.0]})
    try:
        result = Trainer("classification", ["bayes"], 2, 2).train(flowers.where("not held"), flowers.where("held"), "target", FLOWERS)
        assert result.best.params["smoothing"] in (0.5, 1.0)
    finally:
        models.FAMILIES["classification"].pop("bayes")
        models.SPACES["classification"].pop("bayes")


def test_fold_scores(flowers, line):
    tree = search.Candidate("random_forest", None, {"n_estimators": 5}, {}, 0.0)
    logistic = search.Candidate("logistic_regression", None, {}, {}, 0.0)
    scores = search.fold_scores(flowers, "target", FLOWERS, "classification", [tree, logistic], 3, keys=["id"])
    assert set(scores) == {"random_forest", "logistic_regression"}
    assert all(len(s) == 3 and min(s) > 0.6 for s in scores.values())
    ols = search.Candidate("linear_regression", None, {}, {}, 0.0)
    assert min(search.fold_scores(line, "target", ["x1", "x2"], "regression", [ols], 4)[ols.name]) > 0.8
    assert search.fold_scores(line.limit(1), "target", ["x1"], "regression", [ols], 4) == {ols.name: []}


def test_margins_become_probabilities(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([5.0, -5.0],)], "m array<double>")
    rows = [r[0] for r in df.select(models._from_margins(F.col("m"))).collect()]
    assert rows[0] == [0.5, 0.5] and rows[1][0] > 0.999


def test_other_tree_model_on_assembled_vectors(flowers):
    ready = search.assemble(flowers, FLOWERS, "target", "classification", [0, 1, 2])
    assert DecisionTreeClassifier(labelCol="__label").fit(ready).numClasses == 3


def test_steps_of_an_optimiser_run_few_tasks(spark, line):
    ready = search.assemble(line, ["x1", "x2", "x3"], "target", "regression", None).repartition(16)
    few, at_once = search.few_parts(ready, 200, 2)
    assert few.rdd.getNumPartitions() == 1 and at_once >= spark.sparkContext.defaultParallelism
    assert few.count() == 200 and search.few_parts(ready, 2_000_000, 2)[0].rdd.getNumPartitions() == 12
    assert search.few_parts(ready.limit(0), 0, 3)[1] >= 3
