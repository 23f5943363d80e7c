import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tablelearn.operators.features import FillMissing, LabelCodes, OneHot, Scale, TargetMeans
from tablelearn.operators.models import Shape, estimator
from tablelearn.plans.search import assemble, finished
from tablelearn.streaming import scoring


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(600).select(
        "id",
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("at"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 13).cast("double").alias("x"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("c"),
        (F.col("id") % 3 == 0).cast("int").alias("y"),
    )
    path = str(tmp_path / "table")
    df.repartition(4).write.parquet(path)
    return path


@pytest.mark.parametrize("encoder", [OneHot(["c"]), LabelCodes(["c"]), TargetMeans("y", ["c"])])
def test_stream_equals_batch(spark, table, tmp_path, encoder):
    df = spark.read.parquet(table)
    features = Pipeline(stages=[FillMissing("mean", ["x"]), encoder, Scale("standard", ["x"])]).fit(df)
    columns = [c for c in features.transform(df).columns if c not in ("id", "at", "y")]
    ready = assemble(features.transform(df), columns, "y", "classification", [0, 1])
    fitted = estimator("classification", "logistic_regression", {}, Shape("classification", 600, 2)).fit(ready)
    model = finished(fitted, columns, [0, 1], "int")
    model.stages = [*features.stages, *model.stages]
    batch = scoring.score(model, df, ["id"])
    stream = scoring.score(model, scoring.read_stream(spark, table, df.schema), ["id"])
    scoring.write_scores(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["id", "prediction", "probabilities"]
    assert out.count() == 600 and out.exceptAll(batch).count() == 0
    # a second run finds nothing new
    again = scoring.score(model, scoring.read_stream(spark, table, df.schema), ["id"])
    scoring.write_scores(again, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600


def test_windows(spark, table, tmp_path):
    schema = spark.read.parquet(table).schema
    scored = scoring.read_stream(spark, table, schema).withColumn("prediction", F.col("x"))
    counts = scoring.prediction_counts(scored, "at", "1 hour", "1 minute")
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 600


def test_validation(spark, table, tmp_path):
    schema = spark.read.parquet(table).schema
    path = str(tmp_path / "issues")
    assert scoring.stream_issues(spark, path).count() == 0
    stream = scoring.read_stream(spark, table, schema, per_trigger=1)
    scoring.validate_stream(stream, path, str(tmp_path / "state"), max_null_pct=0.05).awaitTermination()
    issues = scoring.stream_issues(spark, path)
    assert {r["column"] for r in issues.select("column").distinct().collect()} == {"x", "c"}
    assert issues.select("batch").distinct().count() >= 4


def test_single_file(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "d"))
    file = next((tmp_path / "d").glob("part-*.parquet"))
    stream = scoring.read_stream(spark, str(file), spark.range(1).schema)
    query = stream.writeStream.format("memory").queryName("one_file").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("one_file").count() == 10
