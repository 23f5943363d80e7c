import pytest

from tablelearn.operators.profile import (
    detect_roles,
    is_stratifiable,
    profile,
    validate,
    validate_completeness,
    validate_ranges,
    validate_schema,
)

def test_schema(flowers):
    issues = validate_schema(flowers, ["target", "nope"], {"target": "int", "stem (cm)": "int", "gone": "int"}).collect()
    assert [(i["column"], i["severity"]) for i in issues] == [("nope", "error"), ("stem (cm)", "warning")]
    assert validate_schema(flowers, ["target"], {"stem (cm)": "float64", "target": "int32"}).count() == 0


def test_completeness(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (float("nan"), 3), (None, 4), (None, 5)], "a double, b int")
    issue = validate_completeness(df, 0.5).collect()
    assert len(issue) == 1 and issue[0]["message"] == "Column a: 80.0% null (max 50.0%)"
    assert validate_completeness(df, 0.8).count() == 0


@pytest.mark.parametrize("schema", ["a int, b string", ""])
def test_empty(spark, schema):
    empty = spark.createDataFrame([], schema) if schema else spark.range(0).select()
    issues = validate_completeness(empty).collect()
    assert len(issues) == 1 and "empty" in issues[0]["message"] and issues[0]["column"] is None


def test_ranges(flowers):
    issues = validate_ranges(flowers, {"target": (0, 1)}).collect()
    assert [i["message"] for i in issues] == ["Column target: max value 2 > 1"]
    assert validate_ranges(flowers, {"target": (0, 2)}).count() == 0
    assert validate_ranges(flowers, {"gone": (0, 1)}).first()["severity"] == "error"


def test_report(flowers):
    report = validate(flowers, ["target"], {"target": "float"}, column_ranges={"stem (cm)": (0, 10)})
    assert report.is_valid and report.warning_count == 1 and report.error_count == 0
    stats = {r["column"]: r for r in report.stats.collect()}
    assert len(stats) == 7 and stats["target"]["n_rows"] == 150 and stats["target"]["null_count"] == 0
    bad = validate(flowers, ["nope"])
    assert not bad.is_valid and {r["severity"]: r["n"] for r in bad.severity_counts().collect()} == {"error": 1}


def test_profile_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x")], "a double, b string")
    assert {r["column"]: r["null_count"] for r in profile(df).collect()} == {"a": 1, "b": 1}


def test_roles(spark):
    df = spark.range(400).selectExpr(
        "id", "id % 3 as few", "cast(id as string) as words", "concat('c', id % 4) as kind",
        "timestamp'2024-01-01 00:00:00' as at", "id % 2 = 0 as flag", "array(id) as list", "id / 7 as real",
    )
    roles = detect_roles(df)
    assert roles.numeric == ["id", "real"] and roles.text == ["words"] and roles.datetime == ["at"]
    assert roles.categorical == ["few", "kind", "flag", "list"]
    # few distinct values, but not few for so small a table
    assert detect_roles(df.limit(20)).numeric == ["id", "few", "flag", "real"]


def test_stratifiable(spark):
    df = spark.range(100).selectExpr("id", "id % 49 as a", "id % 50 as b", "cast(id as string) as s")
    assert [is_stratifiable(df, c) for c in ("id", "a", "b", "s")] == [False, True, False, True]
