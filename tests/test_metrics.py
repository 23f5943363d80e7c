import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.functions import metrics
from tablelearn.operators import compare


def as_dict(long):
    return {r["metric"]: r["value"] for r in long.collect()}


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    s = np.where(rng.random(500) < 0.33, 0.5, np.round(rng.random(500) * 0.8 + 0.2 * y, 2))
    df = spark.createDataFrame([(int(a), float(b), int(b > 0.5), i % 3) for i, (a, b) in enumerate(zip(y, s))],
                               "y int, s double, p int, g int").cache()
    return df, y, s


def test_auc(scored):
    df, y, s = scored
    assert metrics.auc(df, "y", "s", 1).first()["auc_roc"] == pytest.approx(brute_auc(y, s))
    by = {r["g"]: r["auc_roc"] for r in metrics.auc(df, "y", "s", 1, ["g"]).collect()}
    for g in range(3):
        part = np.arange(500) % 3 == g
        assert by[g] == pytest.approx(brute_auc(y[part], s[part]))


def test_auc_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert metrics.auc(df, "y", "s", 1).first()["auc_roc"] is None


def test_auc_one_vs_rest(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    p = rng.dirichlet([1, 1, 1], 300).round(2)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "y int, p array<double>")
    expected = sum(brute_auc((y == c).astype(int), p[:, c]) * (y == c).mean() for c in range(3))
    assert metrics.auc_one_vs_rest(df, "y", "p", [0, 1, 2]).first()["auc_roc"] == pytest.approx(expected)
    assert metrics.auc_one_vs_rest(df, "y", "p", [0, 1, 9]).first()["auc_roc"] is None


def test_classification_by_hand(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] * 2
    df = spark.createDataFrame(rows, "y string, p string")
    m = metrics.classification_wide(df, "y", "p").first()
    assert m["accuracy"] == m["recall"] == pytest.approx(5 / 8)
    assert m["precision"] == pytest.approx((4 * 3 / 5 + 2 * 2 / 3) / 8)
    assert m["f1"] == pytest.approx((4 * 6 / 9 + 2 * 4 / 5) / 8)
    cells = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion(df, "y", "p").collect()}
    assert len(cells) == 9 and cells["c", "c"] == 0 and cells["c", "a"] == 2 and sum(cells.values()) == 8


def test_binary_table_has_auc(scored):
    df, y, s = scored
    probabilities = df.withColumn("probs", F.array(1 - F.col("s"), F.col("s")))
    m = as_dict(metrics.classification(probabilities, "y", "p", "probs", [0, 1]))
    assert set(m) == {"accuracy", "precision", "recall", "f1", "auc_roc"}
    assert m["auc_roc"] == pytest.approx(brute_auc(y, s))
    assert set(as_dict(metrics.classification(df, "y", "p"))) == {"accuracy", "precision", "recall", "f1"}


def test_grouped_confusion(scored):
    df = scored[0]
    cells = metrics.confusion(df, "y", "p", ["g"]).collect()
    assert len(cells) == 12 and sum(r["n"] for r in cells) == 500


def test_regression(spark):
    y, p = np.array([3.0, -0.5, 2.0, 7.0, 0.0]), np.array([2.5, 0.0, 2.0, 8.0, 1.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = as_dict(metrics.regression(df, "y", "p"))
    e = y - p
    assert m["mae"] == pytest.approx(np.abs(e).mean()) and m["mse"] == pytest.approx((e**2).mean())
    assert m["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert m["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert m["mape"] == pytest.approx((np.abs(e) / np.maximum(np.abs(y), np.finfo(float).eps)).mean())
    assert [r["residual"] for r in metrics.residuals(df, "y", "p").collect()] == pytest.approx(list(e))


@pytest.mark.parametrize("prediction, r2", [(5.0, 1.0), (4.0, 0.0)])
def test_r2_of_constant_label(spark, prediction, r2):
    df = spark.createDataFrame([(5.0, prediction)] * 3, "y double, p double")
    assert metrics.regression_wide(df, "y", "p").first()["r2"] == r2


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "y double, p double")
    assert set(metrics.regression_wide(empty, "y", "p").first()) == {None}
    assert set(metrics.classification_wide(empty, "y", "p").first()) == {None}


def test_custom_metric(spark):
    metrics.add_metric("worst", lambda y, p: F.max(F.abs(y - p)))
    try:
        df = spark.createDataFrame([(1.0, 2.0), (1.0, 5.0)], "y double, p double")
        assert as_dict(metrics.regression(df, "y", "p"))["worst"] == 4.0
    finally:
        metrics.CUSTOM.clear()


def test_fold_summary(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("n", None)], "model string, score double")
    got = {r["model"]: (r["cv_mean"], r["cv_std"]) for r in metrics.fold_summary(df).collect()}
    assert got == {"m": (2.0, 1.0), "n": (0.0, 0.0)}


def test_evaluate_by_task(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "y int, p int")
    assert set(as_dict(metrics.evaluate(df, "classification", "y", "p"))) == set(metrics.CLASSIFICATION)
    assert set(as_dict(metrics.evaluate(df, "anything", "y", "p"))) == set(metrics.REGRESSION)


def test_an_added_loss_ranks_the_smaller_first(spark):
    metrics.add_metric("loss", lambda y, p: F.avg(F.abs(y - p)), lower_is_better=True)
    try:
        scores = spark.createDataFrame([("a", 0, "loss", 0.9), ("b", 1, "loss", 0.1)], "model string, position int, metric string, value double")
        ranked = compare.rank_models(scores, "loss").orderBy("rank").collect()
        assert [r["model"] for r in ranked] == ["b", "a"]
    finally:
        metrics.CUSTOM.pop("loss")
        metrics.LOWER_IS_BETTER.discard("loss")
