"""The registered searches, fits and job run the shipped budget."""

from unittest.mock import MagicMock

import pytest

from workload import training

CLASSIFIERS = ["logistic_regression", "random_forest", "xgboost", "lightgbm"]


@pytest.fixture
def calls(monkeypatch):
    """What reaches the search, the job and the fits, without running them."""
    seen = {}
    for name in ("labelled_documents", "documents_measured", "store", "random_split", "F", "results_table", "rounded"):
        monkeypatch.setattr(training, name, MagicMock())
    for name in ("metrics", "predict", "scratch_path", "_split_documents"):
        monkeypatch.setattr(training, name, MagicMock())
    monkeypatch.setattr(training, "Trainer", lambda *a, **k: seen.update(search=(a, k)) or MagicMock())
    job = MagicMock(metrics={}, best_model="m")
    monkeypatch.setattr(training, "run_job", lambda spark, spec, *a, **k: seen.update(spec=spec) or job)
    monkeypatch.setattr(training, "_classified", lambda s, f, name, params: seen.update(params=params))
    monkeypatch.setattr(training, "_fit", lambda df, name, params, *a: seen.update(params=params) or (None, None))
    return seen


@pytest.mark.parametrize("name, first", [("search_classifiers", "logistic_regression"), ("search_regressors", "linear_regression")])
def test_searches_run_whole_spaces(calls, name, first):
    getattr(training, name)(MagicMock(), "")
    args, named = calls["search"]
    assert args[1] == [first, *CLASSIFIERS[1:]]
    assert named == {"n_trials": 10, "cv_folds": 5}


def test_job_runs_the_shipped_search(calls):
    training.training_job(MagicMock(), "")
    spec = calls["spec"]
    assert (spec.training.models, spec.training.n_trials, spec.training.cv_folds) == (CLASSIFIERS, 10, 5)
    assert spec.training.spaces == {} and spec.evaluation.cv_folds == 5


@pytest.mark.parametrize("name", ["train_forest", "train_boosted_by_depth", "train_boosted_by_leaves", "train_boosted_many_classes"])
def test_fits_have_fifty_trees(calls, name):
    getattr(training, name)(MagicMock(), "")
    assert calls["params"]["n_estimators"] >= 50
