import dataclasses

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tablelearn.operators.features import DropMissing
from tablelearn.plans import job as jobs
from tablelearn.plans.registry import Registry, RunLog
from tablelearn.plans.spec import EvaluationSpec, FeatureSpec, JobSpec, TrainingSpec

SPACES = {"random_forest": {"n_estimators": [5], "max_depth": [4]}}


def flower_spec(**changes):
    spec = JobSpec(
        "flowers", "flowers.csv", "target", FeatureSpec(),
        TrainingSpec(models=["logistic_regression", "random_forest"], n_trials=1, cv_folds=2, spaces=SPACES),
        EvaluationSpec(cv_folds=2),
    )
    return dataclasses.replace(spec, **changes)


def test_classification_twice(spark, tmp_path, flowers_csv):
    one = jobs.run_job(spark, flower_spec(data_source=flowers_csv), str(tmp_path))
    assert one.metrics["f1"] > 0.5 and one.metrics["accuracy"] > 0.7 and "auc_roc" in one.metrics
    assert one.promotion["promoted"] and one.promotion["stage"] == "Production" and one.promotion["version"] == 1
    assert one.recommendation.startswith(f"Best model: {one.best_model}")
    assert one.comparison.significance.count() == 1 and one.n_features_selected >= 2
    two = jobs.run_job(spark, flower_spec(data_source=flowers_csv), str(tmp_path))
    assert not two.promotion["promoted"] and two.promotion["stage"] == "Staging" and two.promotion["version"] == 2
    assert two.promotion["champion_score"] == two.promotion["challenger_score"]
    registry = Registry(spark, str(tmp_path))
    raw = jobs.read_source(spark, flowers_csv)
    scored = registry.load_production("flowers").transform(raw)
    assert scored.where("prediction = target").count() > 120
    assert RunLog(spark, str(tmp_path)).history("flowers").count() == 2
    assert registry.list_models().count() == 2


@pytest.fixture(scope="module")
def mixed(spark):
    """Numbers with gaps, categories, times and a numeric target."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, c = float(rng.normal()), "pqr"[int(rng.integers(0, 3))]
        y = 2 * a + {"p": 0, "q": 5, "r": -5}[c] + float(rng.normal(scale=0.1)) + (i % 24) * 0.1
        rows.append((i, None if i % 9 == 0 else a, c if i % 11 else None, 1_700_000_000 + 3600 * i, y))
    df = spark.createDataFrame(rows, "id long, a double, c string, s long, y double")
    return df.select("id", "a", "c", F.timestamp_seconds("s").alias("t"), "y").cache()


@pytest.mark.parametrize("missing, encoding", [("median", "onehot"), ("drop", "target"), ("mode", "label")])
def test_regression(spark, tmp_path, mixed, missing, encoding):
    spec = JobSpec(
        "numbers", "memory", "y",
        FeatureSpec(missing_strategy=missing, categorical_strategy=encoding, datetime_columns=["t"],
                    interaction_columns=["a", "t_hour"], fit_on="train", top_k_features=6),
        TrainingSpec("regression", ["linear_regression"], 1, 2, "r2"),
        EvaluationSpec("r2", cv_folds=2, cv_on="train"),
        key_columns=["id"],
    )
    result = jobs.run_job(spark, spec, str(tmp_path), source=mixed)
    assert set(result.metrics) == {"mae", "mse", "rmse", "r2", "mape"}
    assert result.metrics["r2"] > (0.1 if encoding == "label" else 0.5)
    assert result.comparison.significance.count() == 0
    scored = result.model.transform(mixed.drop("y"))
    expected = mixed.dropna().count() if missing == "drop" else 400
    assert scored.count() == expected


def test_split_is_disjoint_and_complete(spark, mixed):
    spec = JobSpec("n", "m", "y", FeatureSpec(datetime_columns=["t"]), TrainingSpec("regression"), key_columns=["id"])
    ready = jobs.prepare(mixed, spec)
    parts = [ready.part(p).select(jobs.ROW) for p in ("train", "val", "test")]
    assert [p.count() for p in parts] == [280, 40, 80]
    assert parts[0].union(parts[1]).union(parts[2]).distinct().count() == 400


def test_unexpanded_times_are_refused(spark, mixed, tmp_path):
    spec = JobSpec("n", "m", "y", training=TrainingSpec("regression", ["linear_regression"], 1, 2, "r2"), key_columns=["id"])
    with pytest.raises(ValueError, match="datetime_columns"):
        jobs.run_job(spark, spec, str(tmp_path), source=mixed)
    failed = RunLog(spark, str(tmp_path)).history("n").collect()
    assert [r["status"] for r in failed] == ["failed"]


def test_input_check(spark, mixed):
    spec = JobSpec("n", "m", "nope")
    assert not jobs.check_input(mixed, spec).is_valid
    with pytest.raises(ValueError):
        jobs.check_input(mixed, spec, strict=True)


def test_promotion_reasons(spark, tmp_path, mixed):
    registry = Registry(spark, str(tmp_path))
    spec = flower_spec()
    assert jobs.promote(registry, "flowers", "", None, mixed, spec)["reason"] == "model was not registered"
    assert jobs.promote(registry, "flowers", "abc", None, mixed, spec)["reason"] == "registered version not found"
    assert jobs.register_best(registry, "flowers", None, None, []) == ""


@pytest.mark.parametrize(
    "change, text",
    [
        ({"name": ""}, "Pipeline name is required"),
        ({"data_source": ""}, "Data source is required"),
        ({"target_column": ""}, "Target column is required"),
        ({"test_size": 0.0}, "test_size must be between 0 and 1"),
        ({"val_size": 1.0}, "val_size must be between 0 and 1"),
        ({"test_size": 0.6, "val_size": 0.4}, "test_size and val_size must leave rows to train on"),
        ({"training": TrainingSpec("clustering")}, "task_type must be 'classification' or 'regression'"),
        ({"training": TrainingSpec(n_trials=0)}, "n_trials must be >= 1"),
    ],
)
def test_spec_problems(spark, change, text):
    assert flower_spec(**change).problems() == [text]
    with pytest.raises(ValueError):
        jobs.run_job(spark, flower_spec(**change), "/tmp/never")


def test_spec_from_mapping():
    spec = JobSpec.from_mapping(
        {"name": "n", "data_source": "d", "target_column": "t", "feature_config": {"missing_strategy": "drop"},
         "training_config": {"n_trials": 3, "timeout_seconds": 5}, "test_size": 0.3}
    )
    assert spec.features.missing_strategy == "drop" and spec.training.n_trials == 3 and spec.test_size == 0.3
    assert spec.evaluation == EvaluationSpec() and JobSpec.from_mapping(
        {"name": "n", "data_source": "d", "target_column": "t"}
    ) == JobSpec("n", "d", "t")
    for bad in ({"name": "n"}, ["x"], {"name": "n", "data_source": "d", "target_column": "t", "colour": 1}):
        with pytest.raises(ValueError):
            JobSpec.from_mapping(bad)


def test_a_champion_that_cannot_be_loaded_stays(spark, tmp_path, flowers, monkeypatch):
    registry = Registry(spark, str(tmp_path))
    stage = DropMissing(["id"])
    for _ in range(2):
        run_id = registry.register(PipelineModel(stages=[stage]), "m")
    registry.set_stage("m", 1)

    def broken(name):
        raise OSError("storage is away")

    monkeypatch.setattr(registry, "load_production", broken)
    with pytest.raises(OSError):
        jobs.promote(registry, "m", run_id, None, flowers, flower_spec())
    assert registry.production("m")["version"] == 1
    told = jobs.tolerated("promotion", lambda: broken("m"), lambda error: f"error: {error}")
    assert told == "error: storage is away"
