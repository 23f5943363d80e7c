"""Batch and stream scoring with one stored model, and per-batch validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablelearn.operators.profile import validate
from tablelearn.plans.search import predict


def read_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1_000) -> DataFrame:
    """Parquet files of a folder as a stream; a single file is read through its folder."""
    folder, _, name = str(path).rstrip("/").rpartition("/")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if _is_folder(spark, path):
        return files.parquet(str(path))
    return files.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def score(model: PipelineModel, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Input columns (or some of them) with ``prediction`` and ``probabilities``.

    Works alike on a table and on a stream: the model holds its preprocessing.
    """
    scored = predict(model, df)
    if columns is None:
        return scored
    extra = [c for c in ("prediction", "probabilities") if c in scored.columns]
    return scored.select(*columns, *extra)


def write_scores(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a scored stream to Parquet, process what has arrived, and stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def prediction_counts(df: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Predictions per time window; rows later than ``late`` are left out."""
    return (
        df.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"))
    )


def validate_stream(df: DataFrame, path: str, checkpoint: str, **checks) -> StreamingQuery:
    """Validate every micro-batch and store its issues with the batch number.

    A batch that is retried replaces its own issues, so none is stored twice.
    """
    return (
        df.writeStream.foreachBatch(_issue_writer(path, checks))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _issue_writer(path: str, checks: dict) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        issues = validate(batch, **checks).issues
        issues.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stream_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of all batches: ``batch, check, column, message, severity``."""
    schema = "check string, column string, message string, severity string, batch long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
