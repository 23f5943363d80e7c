from datetime import datetime, timezone

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import tablelearn.session as session
from tablelearn.operators.features import Interactions
from tablelearn.plans import registry as reg


@pytest.fixture
def store(spark, tmp_path):
    return reg.Registry(spark, tmp_path)


def model():
    return PipelineModel(stages=[Interactions(["a", "b"])])


def stages(store, name="m"):
    return {r["version"]: r["stage"] for r in store.versions().where(F.col("name") == name).collect()}


def test_register_and_load(spark, store):
    assert store.versions().count() == 0 and store.production("m") is None
    one = store.register(model(), "m", {"f1": 0.9}, {"depth": 3}, ["a"])
    two = store.register(model(), "m")
    store.register(model(), "other")
    assert store.version_of("m", one) == 1 and store.version_of("m", two) == 2 and store.version_of("m", "x") is None
    assert stages(store) == {1: "None", 2: "None"}
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert store.load_version("m", 2).transform(df).first()["a_x_b"] == 6.0
    for missing in (lambda: store.load_version("m", 9), lambda: store.load_production("m")):
        with pytest.raises(LookupError):
            missing()
    row = store.versions().where("version = 1 and name = 'm'").first()
    assert row["metrics"] == {"f1": 0.9} and row["params"] == {"depth": "3"} and row["columns"] == ["a"]


def test_stages(store):
    for _ in range(3):
        store.register(model(), "m")
    store.set_stage("m", 1, reg.PRODUCTION, archive_existing=True)
    store.set_stage("m", 2, reg.STAGING)
    store.set_stage("m", 3, reg.PRODUCTION, archive_existing=True)
    assert stages(store) == {1: "Archived", 2: "Staging", 3: "Production"}
    assert store.production("m")["version"] == 3
    with pytest.raises(ValueError):
        store.set_stage("m", 1, "Elsewhere")


def test_latest_by_number(spark):
    df = spark.createDataFrame(
        [("m", 9, None, "r9"), ("m", 10, None, "r10"), ("m", 2, "Production", "r2")],
        "name string, version long, stage string, run_id string",
    )
    rows = {r["stage"]: (r["version"], r["run_id"]) for r in reg.latest_versions(df).collect()}
    assert rows == {"None": (10, "r10"), "Production": (2, "r2")}


@pytest.mark.parametrize("limit", [0, 100])
def test_promote_newest(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "SMALL_ROWS", limit)
    df = spark.createDataFrame(
        [("first", 1, "None"), ("wins", 1, "Production"), ("wins", 2, "None"), ("loses", 1, "Production"),
         ("loses", 2, "None"), ("left", 1, "None")],
        "name string, version long, stage string",
    )
    decisions = spark.createDataFrame([("first", False), ("wins", True), ("loses", False)], "name string, should_promote boolean")
    got = {(r["name"], r["version"]): r["stage"] for r in reg.promote_newest(df, decisions).collect()}
    assert got == {
        ("first", 1): "Production", ("wins", 1): "Archived", ("wins", 2): "Production", ("loses", 1): "Production",
        ("loses", 2): "Staging", ("left", 1): "None",
    }


def test_run_log(spark, tmp_path):
    log = reg.RunLog(spark, tmp_path)
    assert log.history().count() == 0
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    log.append("a", "completed", now, {"f1": 1})
    log.append("a", "failed", now, error="boom")
    log.append("b", "completed", now)
    assert log.history("a").count() == 2 and log.history().count() == 3
    assert log.history("a").where("status = 'failed'").first()["error"] == "boom"
    assert reg.run_summary(log.history()).count() == 3
