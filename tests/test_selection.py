import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from tablelearn.operators import selection as sel, trees


@pytest.fixture(scope="module")
def near(spark):
    rng = np.random.default_rng(42)
    a = rng.normal(size=100)
    b = a + 0.01 * rng.normal(size=100)
    c = rng.normal(size=100)
    rows = [tuple(float(v) for v in r) for r in zip(a, b, c)]
    return spark.createDataFrame(rows, "a double, b double, c double").cache()


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 7))
    y = (x[:, 2] + 0.3 * x[:, 4] > 0).astype(int)
    rows = [tuple(float(v) for v in r) + ("t", int(t)) for r, t in zip(x, y)]
    columns = ", ".join(f"f{i} double" for i in range(7))
    return spark.createDataFrame(rows, f"{columns}, s string, y int").cache()


def test_correlation(near):
    report = sel.correlation_filter(near, 0.9)
    assert report.selected == ["a", "c"] and report.dropped == ["b"] and report.n_dropped == 1
    assert report.reasons == {"b": "Correlated (>0.9) with a"}
    rows = {r["feature"]: r["selected"] for r in report.rows(near).collect()}
    assert rows == {"a": True, "b": False, "c": True}


def test_dropped_columns_still_drop(spark):
    # b goes because of a, and c because of b, though a and c are far apart.
    df = spark.range(200).select(F.sin("id").alias("a"), F.cos("id").alias("z")).select(
        "a", (F.col("a") + 0.7 * F.col("z")).alias("b"), (F.col("a") + 2.2 * F.col("z")).alias("c")
    )
    report = sel.correlation_filter(df, 0.8)
    assert report.dropped == ["b", "c"] and report.reasons["c"].endswith("with b")


def test_constants_and_text_are_kept(spark):
    df = spark.createDataFrame([(1.0, "x", True), (1.0, "y", False)], "k double, s string, f boolean")
    assert sel.correlation_filter(df).selected == ["k", "s", "f"]
    assert sel.correlation_filter(df.select("s")).selected == ["s"]
    report = sel.variance_filter(df)
    assert report.dropped == ["k"] and report.reasons["k"] == "Variance 0.000000 < 0.01"
    assert sel.variance_filter(df.limit(1)).dropped == []


def test_importance(signal):
    report = sel.importance_filter(signal, "y", top_k=2)
    assert report.selected == ["s", "f2", "f4"] and len(report.dropped) == 5
    assert report.reasons[report.dropped[0]] == "Importance rank 3/7"
    everything = sel.importance_filter(signal, "y", top_k=50)
    assert everything.dropped == [] and everything.n_selected == 8
    assert sel.importance_filter(signal.select("s", "y"), "y").selected == ["s"]
    assert sel.importance_filter(signal, "f2", top_k=1, task="regression").n_dropped == 6


def test_importance_with_own_model(signal):
    tree = DecisionTreeClassifier(labelCol="__label", featuresCol="features", maxDepth=1)
    assert sel.importance_filter(signal, "y", model=tree, top_k=1).selected == ["s", "f2"]


@pytest.mark.parametrize("step", [1, 2])
def test_elimination(signal, step):
    report = sel.recursive_elimination(signal, "y", min_features=3, step=step)
    assert len(report.selected) == 4 and {"f2", "f4"} <= set(report.selected) and report.selected[0] == "s"
    ranks = sorted(int(r.split()[-1]) for r in report.reasons.values())
    assert ranks == ([2, 3, 4, 5] if step == 1 else [2, 2, 3, 3])
    assert sel.recursive_elimination(signal, "y", min_features=7).dropped == []


def test_chain(signal):
    df = signal.withColumn("copy", F.col("f0") * 2).withColumn("flat", F.lit(3.0))
    chosen = sel.select_features(df, "y", top_k=3)
    assert list(chosen.reports) == ["correlation", "variance", "importance"]
    assert chosen.reports["correlation"].dropped == ["copy"] and chosen.reports["variance"].dropped == ["flat"]
    assert chosen.n_selected == 4
    assert sel.select_features(df, "y", exclude=["s"]).selected == [f"f{i}" for i in range(7)]


def test_importances_need_no_tree_on_the_driver(spark, monkeypatch):
    rows = [(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    monkeypatch.setattr(trees, "fit_trees", None)
    assert sel.importance_filter(df, "y", top_k=1).selected == ["a"]
    assert sel.recursive_elimination(df, "y", min_features=1).selected == ["a"]
