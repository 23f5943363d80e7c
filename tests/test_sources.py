import json

import pytest
from pyspark.sql import functions as F

from tablelearn.functions.columns import keep_columns, nan_to_null, numeric_only
from tablelearn.sources.readers import (
    jdbc_options,
    read_csv,
    read_json_payload,
    read_parquet,
    read_source,
)


def test_csv_with_separator(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    df = read_csv(spark, tmp_path / "t.csv", sep=";")
    assert df.columns == ["a", "b"] and df.count() == 2
    assert dict(df.dtypes)["a"] == "int"


def test_csv_with_schema_skips_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,y\n")
    df = read_csv(spark, tmp_path / "t.csv", schema="a double, b string")
    assert [tuple(r) for r in df.orderBy("b").collect()] == [(1.0, "x"), (None, "y")]


@pytest.mark.parametrize("reader", [read_csv, read_parquet, read_json_payload])
def test_missing_file(spark, tmp_path, reader):
    with pytest.raises(FileNotFoundError):
        reader(spark, str(tmp_path / "absent"))


@pytest.mark.parametrize(
    "payload, rows",
    [
        ([{"a": 1, "b": 2}, {"a": 3, "b": 4}], [(1, 2), (3, 4)]),
        ({"data": [{"x": 1}]}, [(1,)]),
        ({"key": "value"}, [("value",)]),
        ({"data": [5, 6]}, [(5,), (6,)]),
    ],
)
def test_json_shapes(spark, tmp_path, payload, rows):
    (tmp_path / "p.json").write_text(json.dumps(payload, indent=1))
    assert sorted(tuple(r) for r in read_source(spark, str(tmp_path / "p.json")).collect()) == rows


def test_source_by_suffix(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert read_source(spark, str(tmp_path / "t.parquet")).count() == 3
    (tmp_path / "t.data").write_text("a\n1\n")
    assert read_source(spark, str(tmp_path / "t.data")).columns == ["a"]
    with pytest.raises(ValueError):
        read_source(spark, "https://example.org/t.csv")


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "a double"))
    assert df.where("a is null").count() == 1
    assert df.agg(F.max("a")).first()[0] == 1.0


def test_jdbc_options():
    plain = jdbc_options("jdbc:x:y", "select 1")
    assert plain["query"] == "select 1" and "dbtable" not in plain
    ranged = jdbc_options("jdbc:x:y", "select * from t", "id", 0, 100, 4)
    assert ranged["dbtable"] == "(select * from t) AS source"
    assert ranged["numPartitions"] == "4" and ranged["lowerBound"] == "0" and ranged["upperBound"] == "100"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x:y", "select 1", "id")


def test_projections(spark):
    df = spark.createDataFrame([(1, "x", True, 2.0)], "a int, b string, c boolean, `d d` double")
    assert numeric_only(df).columns == ["a", "d d"]
    assert keep_columns(df, ["d d", "a"]).columns == ["d d", "a"]
    with pytest.raises(ValueError):
        keep_columns(df, ["z"])


@pytest.mark.parametrize(
    "text, rows",
    [
        ('[{"id": 1, "data": [{"x": 1}, {"x": 2}]}, {"id": 2, "data": []}]', [(1, 2), (2, 0)]),
        ('\n  [{"id": 3, "data": [{"x": 1}]}]', [(3, 1)]),
    ],
)
def test_a_list_keeps_a_column_called_data(spark, tmp_path, text, rows):
    (tmp_path / "a.json").write_text(text)
    found = read_json_payload(spark, str(tmp_path / "a.json"))
    assert sorted((r["id"], len(r["data"])) for r in found.collect()) == rows


def test_filters_on_doubles_reach_the_files(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = read_source(spark, f"{sf}/lineitem.parquet").where("l_extendedprice > 100000 AND l_orderkey > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(l_extendedprice" in plan and "GreaterThan(l_orderkey" in plan
