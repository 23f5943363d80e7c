import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

import tablelearn.session as session
from tablelearn.operators import features as fe


def values(df, column):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(42)
    rows = [
        (i, float(a), float(b), "abc"[int(c)], "xy"[int(d)], int(y))
        for i, (a, b, c, d, y) in enumerate(
            zip(rng.normal(size=200), rng.normal(5, 2, 200), rng.integers(0, 3, 200), rng.integers(0, 2, 200),
                rng.integers(0, 2, 200))
        )
    ]
    return spark.createDataFrame(rows, "id int, num1 double, num2 double, cat1 string, cat2 string, target int").cache()


@pytest.mark.parametrize("strategy, a", [("mean", 7 / 3), ("median", 2.0), ("mode", 1.0), ("unheard", 1.0)])
def test_fill_numbers(spark, strategy, a):
    df = spark.createDataFrame([(1.0, 10), (2.0, 20), (None, 30), (4.0, 40)], "a double, b int")
    out = fe.FillMissing(strategy).fit(df).transform(df)
    assert values(out, "a")[2] == pytest.approx(a) and values(out, "b") == [10, 20, 30, 40]
    assert dict(out.dtypes)["b"] == "int"


def test_fill_other_types(spark):
    at = dt.datetime(2024, 1, 15)
    df = spark.createDataFrame(
        [("x", at, None), ("x", at, None), ("y", None, None), (None, at, None)], "a string, t timestamp, e double"
    )
    out = fe.FillMissing("median").fit(df).transform(df)
    assert values(out, "a")[3] == "x" and out.where("t is null").count() == 0
    assert out.where("e is null").count() == 4


def test_fractional_fill_of_whole_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "a int")
    assert values(fe.FillMissing("mean").fit(df).transform(df), "a")[2] == pytest.approx(7 / 3)


def test_fill_covers_later_gaps(spark):
    model = fe.FillMissing("mean", ["a", "gone"]).fit(spark.createDataFrame([(1.0,), (3.0,)], "a double"))
    later = spark.createDataFrame([(None,), (float("nan"),)], "a double")
    assert values(model.transform(later), "a") == [2.0, 2.0]


def test_drop(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, 5), (None, 6)], "a double, b int")
    assert fe.DropMissing().transform(df).count() == 2
    assert fe.DropMissing(["b"]).transform(df).count() == 3


def test_one_hot(spark, mixed):
    model = fe.OneHot().fit(mixed)
    out = model.transform(mixed)
    assert out.columns == ["id", "num1", "num2", "target", "cat1_a", "cat1_b", "cat1_c", "cat2_x", "cat2_y"]
    assert out.where("cat1_a + cat1_b + cat1_c <> 1 or cat2_x + cat2_y <> 1").count() == 0
    unseen = spark.createDataFrame([("zzz", None)], "cat1 string, cat2 string")
    assert [sum(r) for r in model.transform(unseen).collect()] == [0.0]


def test_one_hot_missing_and_numbers(spark):
    df = spark.createDataFrame([(10, "x"), (9, None)], "n int, s string")
    assert fe.OneHot(["n", "s"]).fit(df).transform(df).columns == ["n_9", "n_10", "s_x", "s_nan"]


def _codes(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("é", 4), ("B", 5)], "s string, k int")
    model = fe.LabelCodes(["s"]).fit(df)
    got = {r["k"]: r["s"] for r in model.transform(df).collect()}
    assert got == {5: 0, 2: 1, 1: 2, 3: 3, 4: 4}
    later = spark.createDataFrame([("zzz",), ("b",)], "s string")
    assert sorted(values(model.transform(later), "s")) == [-1, 2]


def test_label_codes(spark):
    _codes(spark)


def test_label_codes_of_a_large_dictionary(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_ROWS", 2)
    _codes(spark)


def test_large_dictionary_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_ROWS", 10)
    df = spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("s"),
        (F.col("id") % 11).cast("double").alias("y"),
    )
    model = fe.TargetMeans("y", ["s"]).fit(df)
    assert not model.table.small
    rows = df.toPandas()
    means = rows.groupby("s")["y"].mean()
    expected = rows["s"].map(means).fillna(rows["y"].mean())
    got = model.transform(df).toPandas().set_index("id")["s"].sort_index()
    assert np.allclose(got.to_numpy(), expected.to_numpy())
    assert model.transform(df).columns == df.columns


def test_several_large_dictionaries_read_the_table_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "SMALL_ROWS", 10)
    spark.range(3000).select(
        *[F.when(F.col("id") % 3 == i, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias(f"s{i}") for i in range(3)]
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    model = fe.LabelCodes().fit(df)
    out = model.transform(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"file:{tmp_path}/t") == 1
    for i in range(3):
        assert out.agg(F.min(f"s{i}"), F.max(f"s{i}"), F.count_distinct(f"s{i}")).first()[:] == (0, 2000, 2001)


def test_target_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "s string, y double")
    model = fe.TargetMeans("y", ["s"]).fit(df)
    assert values(model.transform(df), "s") == [2.0, 2.0, 5.0, 4.0]
    # scoring needs no target, and unseen values take the global mean
    assert values(model.transform(spark.createDataFrame([("zzz",)], "s string")), "s") == [4.0]


def test_encoder_choice(mixed):
    assert isinstance(fe.encoder("label"), fe.LabelCodes)
    with pytest.raises(ValueError):
        fe.encoder("target")
    with pytest.raises(ValueError):
        fe.encoder("guess")
    nothing = mixed.select("num1")
    for strategy in ("onehot", "label"):
        assert fe.encoder(strategy).fit(nothing).transform(nothing).columns == ["num1"]


@pytest.mark.parametrize(
    "strategy, expected",
    [
        ("standard", lambda x: (x - x.mean()) / x.std()),
        ("minmax", lambda x: (x - x.min()) / (x.max() - x.min())),
        ("robust", lambda x: (x - np.median(x)) / (np.quantile(x, 0.75) - np.quantile(x, 0.25))),
    ],
)
def test_scaling(mixed, strategy, expected):
    out = fe.Scale(strategy, ["num1", "num2"]).fit(mixed).transform(mixed).toPandas()
    before = mixed.toPandas()
    for c in ("num1", "num2"):
        assert np.allclose(out[c], expected(before[c].to_numpy()))


@pytest.mark.parametrize("strategy", fe.SCALERS)
def test_scaling_constants_and_nulls(spark, strategy):
    df = spark.createDataFrame([(0.1, 1.0, True), (0.1, None, False), (0.1, 3.0, True)], "c double, n double, f boolean")
    out = fe.Scale(strategy).fit(df).transform(df)
    assert values(out, "c") == [0.0] * 3 and out.where("n is null").count() == 1
    assert dict(out.dtypes)["f"] == "double"
    with pytest.raises(ValueError):
        fe.Scale("guess")


def test_datetime_parts(spark):
    df = spark.createDataFrame([("2024-01-15 10:30:00",), ("2024-06-22 14:00:00",), (None,)], "ts string")
    rows = [tuple(r) for r in fe.DatetimeParts("ts").transform(df).collect()]
    assert rows == [(10, 15, 1, 0, 0), (14, 22, 6, 5, 1), (None, None, None, None, 0)]
    typed = df.select(F.to_timestamp("ts").alias("ts"))
    assert [tuple(r) for r in fe.DatetimeParts("ts").transform(typed).collect()] == rows


def test_interactions(spark):
    df = spark.createDataFrame([(1, 4, 7, "x"), (2**31 - 1, 2**31 - 1, 9, "y")], "a int, b int, c int, s string")
    out = fe.Interactions(["a", "b", "s", "c"]).transform(df)
    assert out.columns == ["a", "b", "c", "s", "a_x_b", "a_x_c", "b_x_c"]
    assert out.first()["a_x_b"] == 4.0
    assert fe.Interactions(["a", "b"], degree=1).transform(df).columns == df.columns


def _chain(strategy):
    chain = fe.FeatureChain().add_step("fill", "handle_missing", strategy="median")
    return chain.add_step("code", "encode_categorical", strategy=strategy).add_step("scale", "scale_numeric")


@pytest.mark.parametrize("strategy", ["onehot", "label", "target"])
def test_chain(spark, mixed, tmp_path, strategy):
    chain = _chain(strategy)
    fitted = chain.fit_transform(mixed, "target", ["id"])
    assert fitted.exceptAll(chain.transform(mixed)).count() == 0
    assert values(fitted.orderBy("id"), "target") == values(mixed.orderBy("id"), "target")
    chain.save(tmp_path / "deep" / "chain")
    again = fe.FeatureChain.load(tmp_path / "deep" / "chain")
    assert again.transform(mixed).exceptAll(fitted).count() == 0
    assert again.transform(mixed.drop("target")).count() == 200


def test_chain_errors(mixed):
    with pytest.raises(RuntimeError):
        _chain("label").transform(mixed)
    with pytest.raises(RuntimeError):
        _chain("label").save("/tmp/never")
    with pytest.raises(ValueError):
        fe.FeatureChain().add_step("x", "no_such_method")


def test_custom_step(mixed):
    fe.add_method("halve", lambda target=None, exclude=(), **p: fe.Interactions(["num1", "num2"]))
    try:
        out = fe.FeatureChain().add_step("mine", "halve").fit_transform(mixed)
        assert "num1_x_num2" in out.columns
    finally:
        fe.METHODS.pop("halve")


def test_stages_survive_storage(spark, tmp_path, mixed):
    stages = [fe.DropMissing(["num1"]), fe.Interactions(["num1", "num2"]), fe.OneHot(["cat1"]), fe.LabelCodes(["cat2"])]
    model = Pipeline(stages=stages).fit(mixed)
    model.write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert back.transform(mixed).exceptAll(model.transform(mixed)).count() == 0


def test_one_hot_vector_says_the_same_as_columns(spark, tmp_path):
    rows = [("b", "x", 1.0), ("a", None, 2.0), ("c", "y", 3.0), (None, "x", 4.0)]
    df = spark.createDataFrame(rows, "s string, t string, n double")
    later = spark.createDataFrame([("zzz", "y", 5.0), ("a", "zzz", 6.0), (None, None, 7.0)], "s string, t string, n double")
    dense, sparse = fe.OneHot().fit(df), fe.OneHotVector().fit(df)
    sparse.write().save(str(tmp_path / "m"))
    for frame in (df, later):
        flags = {r["n"]: sum(v for k, v in r.asDict().items() if k != "n") for r in dense.transform(frame).collect()}
        for model in (sparse, PipelineModel.load(str(tmp_path / "m"))):
            out = model.transform(frame)
            assert out.columns == ["n", "categories"]
            for r in out.collect():
                assert r["categories"].size == 7 and r["categories"].toArray().sum() == flags[r["n"]]


def test_one_hot_vector_of_very_many_categories(spark):
    df = spark.range(12_000).select(F.concat(F.lit("k"), "id").alias("s"), "id")
    out = fe.OneHotVector(["s"]).fit(df).transform(df)
    places = {int(r["categories"].indices[0]) for r in out.select("categories").collect()}
    assert places == set(range(12_000)) and out.columns == ["id", "categories"]


@pytest.mark.parametrize("strategy", fe.SCALERS)
def test_nan_is_no_value_to_a_scaler(spark, strategy):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),)], "x double")
    got = [r["x"] for r in fe.Scale(strategy).fit(df).transform(df).collect()]
    clean = df.where("not isnan(x)")
    assert got[:3] == [r["x"] for r in fe.Scale(strategy).fit(clean).transform(clean).collect()] and got[3] is None


def test_a_small_dictionary_is_broadcast_beside_a_large_one(spark, monkeypatch):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("large"), (F.col("id") % 5).cast("string").alias("small"))
    monkeypatch.setattr(session, "SMALL_ROWS", 100)
    monkeypatch.setattr(fe, "SMALL_ROWS", 100)
    model = fe.LabelCodes(["large", "small"]).fit(df)
    assert [t.small for t in model._tables()] == [False, True]
    assert model.transform(df).agg(F.max("large"), F.max("small")).first() == (2999, 4)
