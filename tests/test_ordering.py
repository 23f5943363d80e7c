"""Searches and ranks against brute force, with thresholds small enough to take the long way."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tablelearn.session as session
from tablelearn.functions import ordering, stats
from tablelearn.functions.student import two_sided_p


@pytest.fixture
def tiny_tables(monkeypatch):
    """No learned table counts as small: everything takes the distributed way."""
    monkeypatch.setattr(session, "SMALL_ROWS", 0)


def _skewed(spark, n=4000):
    """A third of the rows shares one value; the rest is heavy-tailed with huge outliers."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(7.25))
        .when(F.col("id") == 100, F.lit(1e300))
        .when(F.col("id") == 101, F.lit(-1e300))
        .otherwise(F.pow(F.lit(1.01), (F.col("id") * 7919) % 1000) - 50)
        .alias("x"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 31) % 17).alias("y"),
    )


def test_order_statistics(spark):
    df = _skewed(spark)
    x = np.sort([r["x"] for r in df.collect()])
    ranks = [1, 2, 17, 1000, 2000, 2001, 3999, 4000]
    found = ordering.order_statistics(df, {"x": ranks}, {"x": 4000}, limit=10)
    for r in ranks:
        s = found["x", r]
        assert s.value == x[r - 1]
        assert s.below == (x < s.value).sum() and s.equal == (x == s.value).sum()


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_quantiles(spark, limit):
    df = _skewed(spark)
    rows = df.toPandas()
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = stats.quantiles(df, ["x", "y"], shares, limit=limit)
    assert np.allclose(found["x"], np.quantile(rows["x"], shares))
    assert np.allclose(found["y"], np.nanquantile(rows["y"], shares))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert stats.quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_global_rank(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 13).alias("g"))
    ranked = ordering.global_rank(df.repartition(7), ["g", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 5001))
    assert [(r["g"], r["id"]) for r in ranked] == sorted((i * 7919 % 13, i) for i in range(5000))


def test_ranks_shuffle_their_rows_once(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), F.lit("x").alias("t"))
    ranked = ordering.global_rank(df, ["id"])
    # What is left after the stored range shuffle is narrow: a scan and the join with the offsets.
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan and "Window" not in plan
    assert ranked.where(F.col("rank") != F.col("id") + 1).count() == 0 and ranked.count() == 5000
    assert ordering.global_rank(df.limit(0), ["id"]).collect() == []


def test_running_totals(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    rows = ordering.running_totals(df, ["id"], ["v"]).orderBy("id").collect()
    before = 0
    for r in rows:
        assert r["before_v"] == before
        before += r["v"]


@pytest.mark.parametrize("digits", [1, 5])
def test_hash_cuts(spark, digits):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("s"))
    targets = spark.createDataFrame(
        [("hot", 0, 0), ("hot", 1, 1), ("hot", 2, 1000), ("cold", 0, 700)], "stratum string, cut int, rank long"
    )
    cuts = ordering.hash_cuts(df, F.col("s"), ordering.order_hash(df, ["id"], 1), targets, digits).collect()
    hashes = {
        s: sorted(hashlib.md5(f"1-{i}".encode()).hexdigest() for i in range(3000) if (i % 3 == 0) == (s == "hot"))
        for s in ("hot", "cold")
    }
    assert {(r["stratum"], r["cut"]): r["threshold"] for r in cuts} == {
        ("hot", 0): "", ("hot", 1): hashes["hot"][0], ("hot", 2): hashes["hot"][-1], ("cold", 0): hashes["cold"][699],
    }


def test_hash_cuts_distributed(spark, tiny_tables):
    test_hash_cuts(spark, 2)


def test_prefix_digits():
    assert [ordering.prefix_digits(n) for n in (0, 1, 10**6, 2 * 10**7, 10**9, 10**12, 10**14)] == [1, 1, 1, 3, 4, 5, 5]


def test_fitted_tables_keep_their_bounds(spark):
    rows = spark.range(50).select("id", F.repeat(F.lit("x"), 10).alias("t"))
    assert session.fit_table(rows).small and session.fit_table(rows).total("id") == 1225
    large = session.fit_table(rows, max_rows=49)
    assert not large.small and large.df.count() == 50 and large.total("id") == 1225
    with pytest.raises(ValueError):
        large.rows()
    wide = spark.range(3).select(F.when(F.col("id") == 1, F.repeat(F.lit("x"), 5000)).alias("t"))
    kept = session.fit_table(wide)
    assert not kept.small and kept.df.agg(F.max(F.length("t"))).first()[0] == 5000


def test_modes(spark):
    df = spark.createDataFrame(
        [(1, "b", 2.5, True, None), (1, "a", 1.5, False, None), (2, "b", 1.5, False, None), (2, "a", None, None, None)],
        "i int, s string, d double, f boolean, n string",
    )
    assert stats.modes(df, df.columns) == {"i": 1, "s": "a", "d": 1.5, "f": False, "n": None}


@pytest.mark.parametrize("copies", [1, 3])
def test_mode_of_long_texts(spark, copies):
    texts = [c * 600 for c in "dcb"] * copies + ["short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = "b" * 600
    assert stats.modes(df, ["t"])["t"] == expected


def test_distinct_counts(spark):
    df = spark.range(5000).select("id", (F.col("id") % 14).alias("a"), F.lit(None).cast("string").alias("n"))
    counts = stats.distinct_counts(df, ["id", "a", "n"])
    assert counts["a"] == 14 and counts["n"] == 0 and counts["id"] > 3000


def test_rows_and_distinct_values_take_one_scan(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.range(3000).selectExpr(
        "id % 1000 as k", "concat('', id % 49) as s", "if(id % 2 = 0, 0.0D, -0.0D) as zero", "'' as none", "id % 2 = 0 as f"
    )
    df = source.mapInArrow(watched, source.schema)
    n, counts = stats.rows_and_distinct(df, df.columns)
    assert n == 3000 and counts == {"k": 1000, "s": 49, "zero": 1, "none": 1, "f": 2}
    assert seen.value == 3000
    assert stats.rows_and_distinct(source.limit(0), ["k", "s"]) == (0, {"k": 0, "s": 0})


@pytest.mark.parametrize("block", [3, 64])
def test_blocks_of_columns_do_not_matter(spark, block):
    columns = [F.sin(F.col("id") * (k + 0.5)).alias(f"c.{k}") for k in range(5)]
    columns += [F.when(F.col("id") % 9 != 0, F.col("id") % 11).alias("gap`s"), F.lit(2.5).alias("flat")]
    columns += [(F.sin(F.col("id") * 0.5) * 3 + 1e6).alias("again")]
    df = spark.range(700).select(*columns)
    whole = {(r["i"], r["j"]): r for r in stats.correlations(df, df.columns).collect()}
    parts = {(r["i"], r["j"]): r for r in stats.correlations(df, df.columns, block=block).collect()}
    assert len(parts) == 28 and parts.keys() == whole.keys()
    for k, r in parts.items():
        assert (r["left"], r["right"]) == (df.columns[k[0]], df.columns[k[1]])
        assert r["r"] == (None if whole[k]["r"] is None else pytest.approx(whole[k]["r"], abs=1e-9))
    high = stats.correlations(df, df.columns, above=0.9, block=block).collect()
    assert [(r["left"], r["right"]) for r in high] == [("c.0", "again")]


def test_correlations_of_wide_tables(spark):
    # 1,100 columns are three blocks; column k + 1,000 repeats column k.
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 1000))
    x = np.hstack([x, x[:, :100] * -2.0])
    df = spark.createDataFrame(pa.table({f"c{i}": x[:, i] for i in range(1100)}))
    high = {(r["i"], r["j"]): r["r"] for r in stats.correlations(df, df.columns, above=0.999).collect()}
    assert high.keys() == {(i, i + 1000) for i in range(100)} and max(high.values()) < -0.999


def test_correlations(spark):
    df = spark.range(500).select(
        (F.sin(F.col("id") * 1.0) + 1e6).alias("a"),
        F.when(F.col("id") % 7 != 0, F.cos(F.col("id") * 0.3)).alias("b"),
        (F.sin(F.col("id") * 1.0) * 3 + F.cos(F.col("id") * 0.3)).alias("c"),
        F.lit(0.1).alias("flat"),
    )
    expected = df.toPandas().corr()
    for r in stats.correlations(df, df.columns).collect():
        if "flat" in (r["left"], r["right"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(expected.loc[r["left"], r["right"]], abs=1e-9)


@pytest.mark.parametrize("width", [2, 3, 4, 5, 12])
def test_gaps_give_one_answer_for_any_width(spark, width):
    columns = [F.when(F.col("id") % 97 == 0, F.lit(float("nan"))).otherwise(F.sin(F.col("id") * 1.0)).alias("c0")]
    columns += [F.when(F.col("id") % (20 + k) != 0, F.cos(F.col("id") * (k + 0.5))).alias(f"c{k}") for k in range(1, width)]
    df = spark.range(4000).select(*columns)
    expected = df.toPandas().corr()
    found = stats.correlations(df, df.columns).collect()
    assert len(found) == width * (width - 1) // 2
    for r in found:
        assert r["r"] == pytest.approx(expected.loc[r["left"], r["right"]], abs=1e-9)


@pytest.mark.parametrize("n", [1000, 2_000_000])
def test_constant_where_the_partner_is_present(spark, n):
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(0.1)).otherwise(F.col("id") / n).alias("a"),
        F.when(F.col("id") % 2 == 0, F.sin(F.col("id") * 1.0)).alias("b"),
        (F.lit(1e9) + F.cos(F.col("id") * 0.7)).alias("c"),
        (F.lit(-1e9) + F.cos(F.col("id") * 0.7)).alias("d"),
    )
    found = {(r["left"], r["right"]): r["r"] for r in stats.correlations(df, df.columns).collect()}
    assert found["a", "b"] is None and found["c", "d"] == pytest.approx(1, abs=1e-6)


def test_a_stuck_search_does_not_stop_the_others(spark):
    df = spark.range(200_000).select((F.col("id") % 2).cast("double").alias("half"), F.rand(3).alias("price")).cache()
    prices = np.sort(df.select("price").toPandas()["price"])
    wanted = {"half": [100_000, 100_001], "price": [50_000, 100_000]}
    found = ordering.order_statistics(df, wanted, {"half": 200_000, "price": 200_000}, limit=10)
    assert (found["half", 100_000].value, found["half", 100_001].value) == (0.0, 1.0)
    assert found["price", 50_000].value == prices[49_999] and found["price", 100_000].value == prices[99_999]


def test_different_keys_have_different_hashes(spark):
    rows = [("1-2", "3"), ("1", "2-3"), (None, "x"), ("", "x"), ("\\0", "x"), ("\\", "-x"), ("\\-", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(ordering.order_hash(df, None, 1)).distinct().count() == len(rows)


def test_variances_and_moments(spark):
    df = spark.createDataFrame([(2.0, 5.0), (1.0, None), (7.0, None), (9.0, None)], "a double, b double")
    v = stats.variances(df, ["a", "b"])
    assert v["a"] == pytest.approx(np.var([2, 1, 7, 9], ddof=1)) and v["b"] is None
    assert stats.moments(df, ["a"])["a"]["std"] == pytest.approx(np.std([2, 1, 7, 9]))


def test_two_sided_p(spark):
    # Textbook 5% and 1% points of Student's t.
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.571, 5, 0.05),
             (2.262, 9, 0.05), (2.228, 10, 0.05), (4.604, 4, 0.01), (3.169, 10, 0.01), (0.0, 4, 1.0)]
    df = spark.createDataFrame([(t, d, p) for t, d, p in known], "t double, dof long, p double")
    for r in df.withColumn("got", two_sided_p(F.col("t"), F.col("dof"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-4)
