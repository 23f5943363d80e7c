import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import tablelearn.session as session
from tablelearn.operators import splits


def counts(df, *by):
    return {tuple(r)[:-1] if len(by) > 1 else r[0]: r[-1] for r in df.groupBy(*by).count().collect()}


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds a third of the rows, the others are spread thin."""
    return spark.range(3001).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("y"),
        (F.col("id") * 7919 % 2999).cast("double").alias("x"),
    ).cache()


def test_sizes(spark, skewed):
    split = splits.random_split(skewed, "x", 0.2, 0.1, keys=["id"])
    assert counts(split, "split") == {"test": 601, "val": 300, "train": 2100}
    shapes = {r["split"]: (r["n_rows"], r["n_columns"]) for r in splits.split_shapes(split).collect()}
    assert shapes == {"train": (2100, 3), "val": (300, 3), "test": (601, 3)}


def _stratified(skewed):
    split = splits.random_split(skewed, "y", 0.2, 0.1, keys=["id"])
    assert counts(split, "split") == {"test": 601, "val": 300, "train": 2100}
    sizes = counts(skewed, "y")
    for (y, part), n in counts(split, "y", "split").items():
        share = {"test": 0.2, "val": 0.1, "train": 0.7}[part]
        assert abs(n - share * sizes[y]) < 2
    assert split.drop("split").exceptAll(skewed).count() == 0 and split.count() == 3001


def test_stratified(skewed):
    _stratified(skewed)


def test_stratified_without_small_tables(skewed, monkeypatch):
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    _stratified(skewed)


def test_both_ways_agree(skewed, monkeypatch):
    one = splits.random_split(skewed, "y", keys=["id"]).select("id", "split").collect()
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    two = splits.random_split(skewed, "y", keys=["id"]).select("id", "split").collect()
    assert sorted(one) == sorted(two)


def test_no_validation_part(skewed):
    assert counts(splits.random_split(skewed, "y", 0.25, 0.0, keys=["id"]), "split") == {"test": 751, "train": 2250}


def test_repeatable_and_seeded(skewed):
    one, two, other = (
        splits.random_split(skewed.repartition(n), "x", keys=["id"], seed=s).where("split = 'test'").select("id")
        for n, s in ((3, 1), (7, 1), (3, 2))
    )
    assert one.exceptAll(two).count() == 0 and one.exceptAll(other).count() > 0


def test_missing_labels_form_a_class(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 60, "a").alias("y"))
    parts = counts(splits.random_split(df, "y", 0.2, 0.0, keys=["id"]), "y", "split")
    assert parts[None, "test"] == 8 and parts["a", "test"] == 12


def test_lonely_class(spark):
    df = spark.range(20).select("id", F.when(F.col("id") == 0, "one").otherwise("many").alias("y"))
    with pytest.raises(ValueError):
        splits.random_split(df, "y", keys=["id"])
    few = spark.range(40).select("id", (F.col("id") % 20).alias("y"))
    with pytest.raises(ValueError):
        splits.random_split(few, "y", 0.2, 0.1, keys=["id"])


def test_target_that_becomes_classes(spark):
    """Fifty values in the whole, fewer once the test rows are gone."""
    df = spark.range(58).select("id", F.when(F.col("id") < 49, F.col("id") % 2).otherwise(F.col("id") * 1000).alias("y"))
    df = df.unionByName(spark.range(100, 400).select("id", F.when(F.col("id") < 140, F.col("id")).otherwise(1).alias("y")))
    split = splits.random_split(df, "y", 0.2, 0.0, keys=["id"])
    assert counts(split, "split")["test"] == 72


@pytest.fixture(scope="module")
def repeated(spark):
    """1,000 rows of which 400 are equal."""
    return spark.range(1000).select(
        F.greatest(F.col("id"), F.lit(400)).alias("k"), F.when(F.col("id") < 500, "a").otherwise("b").alias("y")
    ).repartition(5).cache()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("target", ["k", "y"])
def test_sizes_are_exact_where_rows_repeat(repeated, seed, target):
    split = splits.random_split(repeated, target, 0.2, 0.1, seed=seed).cache()
    assert counts(split, "split") == {"test": 200, "val": 100, "train": 700}
    assert split.drop("split").exceptAll(repeated).count() == 0
    if target == "y":
        assert counts(split, "y", "split")[("a", "test")] == 100


@pytest.mark.parametrize("target", ["k", "y"])
def test_folds_are_even_where_rows_repeat(repeated, monkeypatch, target):
    assert set(counts(splits.k_folds(repeated, target, 5), "fold").values()) == {200}
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    assert set(counts(splits.k_folds(repeated, target, 5), "fold").values()) == {200}


def test_time_order_of_large_whole_numbers(spark):
    df = spark.range(1000).select("id", (F.lit(1_700_000_000_000_000_000) + F.col("id")).alias("t")).repartition(4)
    rows = splits.time_split(df, "t", 0.2, 0.1, keys=["id"]).collect()
    assert {r["id"]: r["split"] for r in rows} == {
        i: "train" if i < 700 else "val" if i < 800 else "test" for i in range(1000)
    }


def test_time_split_of_repeated_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 900, F.lit(None)).otherwise(F.col("id") % 2).alias("t"))
    assert counts(splits.time_split(df, "t", 0.2, 0.1), "split") == {"train": 700, "val": 100, "test": 200}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, y string")
    assert splits.random_split(df, "y", keys=["id"]).count() == 0


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds(skewed, k):
    folded = splits.k_folds(skewed, "x", k, stratify=False, keys=["id"])
    sizes = counts(folded, "fold")
    assert set(sizes) == set(range(k)) and sum(sizes.values()) == 3001 and max(sizes.values()) - min(sizes.values()) <= 1


def test_stratified_folds(skewed):
    folded = splits.k_folds(skewed, "y", 5, keys=["id"])
    sizes = counts(folded, "fold")
    assert max(sizes.values()) - min(sizes.values()) <= 1
    table = folded.groupBy("y").pivot("fold").count().na.fill(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in table)


def test_stratified_folds_without_small_tables(skewed, monkeypatch):
    one = sorted(splits.k_folds(skewed, "y", 3, keys=["id"]).select("id", "fold").collect())
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    assert sorted(splits.k_folds(skewed, "y", 3, keys=["id"]).select("id", "fold").collect()) == one


def test_fold_parts(skewed):
    folded = splits.k_folds(skewed, "y", 3, keys=["id"])
    for train, val in splits.fold_parts(folded, 3):
        assert train.count() + val.count() == 3001
        assert train.select("id").intersect(val.select("id")).count() == 0


@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_time_split(spark, limit):
    start = dt.datetime(2024, 1, 1)
    # Half of all rows share one moment, and some have none.
    rows = [(i, None if i % 50 == 0 else start + dt.timedelta(hours=100 if i % 2 else i % 400)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, t timestamp")
    split = splits.time_split(df, "t", 0.2, 0.1, keys=["id"], limit=limit).toPandas()
    n = np.array([(split["split"] == p).sum() for p in ("train", "val", "test")])
    assert list(n) == [700, 100, 200] or list(n) == [int(1000 * (1 - 0.2 - 0.1)), 800 - int(1000 * (1 - 0.2 - 0.1)), 200]
    at = split["t"].fillna(np.datetime64("2262-01-01"))
    ends = [(at[split["split"] == p].min(), at[split["split"] == p].max()) for p in ("train", "val", "test")]
    assert ends[0][1] <= ends[1][0] and ends[1][1] <= ends[2][0]


def test_time_split_of_text_times(spark):
    df = spark.range(200).select("id", F.date_format(F.timestamp_seconds(F.col("id") * 3600), "yyyy-MM-dd HH:mm:ss").alias("t"))
    split = splits.time_split(df, "t", keys=["id"])
    assert counts(split, "split")["test"] == 40 and split.where("split = 'test'").agg(F.min("id")).first()[0] == 160


def test_plan_moves_no_rows(skewed, spark, tmp_path):
    """Applying a split is a scan and a comparison: no exchange but the tiny broadcast."""
    skewed.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = splits.random_split(df, "x", keys=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    plan = splits.random_split(df, "y", keys=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
