"""Readers: files, landed JSON payloads and databases, all as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablelearn.functions.columns import nan_to_null


def _found(load, path: str, kind: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{kind} file not found: {path}") from error
        raise


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Pass ``schema`` on large inputs: inferring reads the file twice."""
    reader = spark.read.options(**{"header": True, **options})
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(_found(lambda: reader.csv(str(path)), path, "CSV"))


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet as it is, so that filters on every column reach the files; operators read NaN as missing."""
    return _found(lambda: spark.read.options(**options).parquet(str(path)), path, "Parquet")


def read_json_payload(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """Landed API responses: a list of objects, an object with ``data``, or one object.

    One response per file, or with ``lines`` one per line, which splits large files.
    The shape is that of the top level: rows of a list keep their columns, also one
    named ``data``; only a response that is one object is replaced by its ``data``.
    All files of a path have one shape. With ``lines`` a line is one object.
    """
    reader = spark.read.option("multiLine", not lines)
    raw = _found(lambda: (reader.schema(schema) if schema is not None else reader).json(str(path)), path, "JSON")
    if "data" not in raw.columns or (not lines and _is_list(spark, path)):
        return nan_to_null(raw)
    kind = raw.schema["data"].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return nan_to_null(raw.select(F.inline("data")))
    if isinstance(kind, T.ArrayType):
        return raw.select(F.explode("data").alias("0"))
    return raw


def _is_list(spark: SparkSession, path: str) -> bool:
    """Whether the responses begin with a bracket; looks at the first line with text of one file."""
    first = spark.read.text(str(path)).where(F.col("value").rlike(r"\S")).take(1)
    return bool(first) and first[0]["value"].lstrip("\ufeff \t").startswith("[")


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; with a partition column the query is read in parallel ranges."""
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None or not partitions:
        raise ValueError("a partitioned read needs lower, upper and partitions")
    return {
        **options,
        "dbtable": f"({query}) AS source",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_database(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Any SQL query, run by the database; see ``jdbc_options`` for parallel reads."""
    return nan_to_null(spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load())


def read_source(spark: SparkSession, source: str, **options) -> DataFrame:
    """Choose the reader by suffix; anything unknown is read as CSV."""
    name = str(source).lower()
    if name.startswith(("http://", "https://")):
        raise ValueError("land remote payloads in shared storage first, then read them with read_json_payload")
    if name.endswith(".parquet"):
        return read_parquet(spark, source, **options)
    if name.endswith(".json"):
        return read_json_payload(spark, source, **options)
    return read_csv(spark, source, **options)
