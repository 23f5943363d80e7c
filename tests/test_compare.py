import pytest

from tablelearn.functions import metrics
from tablelearn.operators import compare


def long(spark, *models):
    rows = [(name, i, m, float(v)) for i, (name, values) in enumerate(models) for m, v in values.items()]
    return spark.createDataFrame(rows, "model string, position int, metric string, value double")


def test_ranking(spark):
    scores = long(spark, ("a", {"f1": 0.7}), ("b", {"f1": 0.9}), ("c", {"f1": 0.7}), ("d", {"accuracy": 1.0}))
    ranked = compare.rank_models(scores, "f1").orderBy("rank").collect()
    assert [(r["model"], r["rank"]) for r in ranked] == [("b", 1), ("a", 2), ("c", 3), ("d", 4)]
    assert compare.best_model(scores, "f1").first()["model"] == "b"
    errors = long(spark, ("a", {"mae": 0.7}), ("b", {"mae": 0.2}))
    assert compare.best_model(errors, "mae").first()["model"] == "b"


def test_table(spark):
    scores = long(spark, ("a", {"f1": 0.7, "accuracy": 0.6}), ("b", {"f1": 0.9, "accuracy": 0.8}))
    times = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "model string, training_time double")
    table = compare.comparison_table(scores, "f1", ["accuracy", "f1"], times)
    assert table.columns == ["rank", "model", "accuracy", "f1", "training_time"]
    assert tuple(table.orderBy("rank").first()) == (1, "b", 0.8, 0.9, 2.5)


def _test(spark, a, b, **options):
    rows = [("a", i, x) for i, x in enumerate(a)] + [("b", i, x) for i, x in enumerate(b)]
    folds = spark.createDataFrame(rows, "model string, fold int, score double")
    ranking = spark.createDataFrame([("a", 1), ("b", 2)][: 1 + bool(b)], "model string, rank int")
    return compare.paired_t_test(folds, ranking, **options).collect()


def test_paired_t_test(spark):
    # d = .1 .2 .3 .4: mean .25, sample std .1290994, t = 3.8729833, 3 degrees of freedom
    row = _test(spark, [0.6, 0.7, 0.8, 0.9], [0.5, 0.5, 0.5, 0.5])[0]
    assert row["t_statistic"] == pytest.approx(3.8729833) and row["p_value"] == pytest.approx(0.0305, abs=1e-4)
    assert row["significant"] and row["test"] == "paired_t_test"
    assert not _test(spark, [0.6, 0.7, 0.8, 0.9], [0.5, 0.5, 0.5, 0.5], level=0.01)[0]["significant"]


def test_paired_t_test_edges(spark):
    same = _test(spark, [0.5, 0.6], [0.5, 0.6])[0]
    assert same["p_value"] is None and not same["significant"]
    constant = _test(spark, [1.5, 2.5], [1.0, 2.0])[0]
    assert constant["p_value"] == 0.0 and constant["significant"]
    assert _test(spark, [0.5], [0.6])[0]["test"] == "insufficient_data"
    assert _test(spark, [0.5, 0.6], []) == []


@pytest.mark.parametrize(
    "task, values, texts",
    [
        ("classification", {"f1": 0.3, "precision": 0.5, "recall": 0.2}, [compare.LOW_F1, compare.GAP]),
        ("classification", {"f1": 0.8, "precision": 0.95, "recall": 0.6, "auc_roc": 0.9}, [compare.GAP]),
        ("classification", {"f1": 0.8, "precision": 0.0, "recall": 0.6, "auc_roc": 0.6}, [compare.LOW_AUC]),
        ("regression", {"r2": 0.2, "mape": 0.1}, [compare.LOW_R2]),
        ("regression", {"r2": 0.8, "mape": 0.5}, [compare.HIGH_MAPE]),
        ("regression", {"r2": 0.8, "mape": 0.1}, []),
    ],
)
def test_recommendations(spark, task, values, texts):
    rows = compare.recommendations(long(spark, ("m", values)), task).collect()
    assert [r["recommendation"] for r in rows] == texts


def test_summary_text():
    test = {"test": "paired_t_test", "model_b": "b", "p_value": 0.012, "significant": True}
    text = compare.summary_text("a", "f1", 0.91234, 0.9, 0.01, test)
    assert text.startswith("Best model: a (f1=0.9123, CV mean=0.9000 +/- 0.0100). Statistically")
    assert "NOT" in compare.summary_text("a", "f1", 0.9, 0.9, 0.01, {**test, "significant": False})
    assert compare.summary_text("a", "f1", 0.9, 0.9, 0.01, None).endswith(")")


def test_promotion(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 0), (1, 1, 1), (0, 1, 1)], "y int, new int, old int")
    row = compare.promotion_decision(df, "y", "new", "old").first()
    f1 = [metrics.classification_wide(df, "y", c).first()["f1"] for c in ("new", "old")]
    assert [row["new_score"], row["current_score"]] == f1 and row["should_promote"]
    assert row["reason"] == f"New model improves by {f1[0] - f1[1]:.4f} (higher is better)"
    same = compare.promotion_decision(df, "y", "old", "old").first()
    assert not same["should_promote"] and "threshold=0.01" in same["reason"]
    # exactly the wanted improvement is enough
    numbers = spark.createDataFrame([(0.0, 1.0, 2.0)], "y double, new double, old double")
    assert compare.promotion_decision(numbers, "y", "new", "old", "regression", 3.0).first()["should_promote"]
    assert not compare.promotion_decision(numbers, "y", "new", "old", "regression", 3.1).first()["should_promote"]
