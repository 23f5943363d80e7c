"""The Java that grows trees in the executors' JVM.

Growing a tree adds a few numbers per row, column and level at places that follow from the row; Java does that some times
faster than arrays of all rows can. ``Grower.java`` is compiled by the compiler that Spark has for the code it makes of
queries, and sent to the executors as a jar.
"""

from __future__ import annotations

import logging
import os
import tempfile
import threading
import zipfile
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, types as T

log = logging.getLogger(__name__)
SOURCE = Path(__file__).with_name("Grower.java")
# By application: the class loader that has the compiled classes, or None if they could not be made.
_LOADERS: dict[str, Any] = {}
_LOCK = threading.Lock()

ROWS = "fit int, part int, output int, number int, a binary, b binary, c binary, d binary"


def _compiled(spark: SparkSession) -> Any:
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(SOURCE.read_text())
    jar = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tablelearn-")), "tablelearn-grower.jar")
    with zipfile.ZipFile(jar, "w") as out:
        for name, code in dict(compiler.getBytecodes()).items():
            out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    spark.sparkContext._jsc.addJar(jar)
    return compiler.getClassLoader()


def loader(spark: SparkSession) -> Any:
    """The class loader of the compiled classes; None where they cannot be compiled or sent."""
    application = spark.sparkContext.applicationId
    with _LOCK:
        if application not in _LOADERS:
            try:
                _LOADERS[application] = _compiled(spark)
            except Exception as error:
                log.warning("trees are grown without Java: %s", error)
                _LOADERS[application] = None
        return _LOADERS[application]


def _given(spark: SparkSession, *args: Any) -> Any:
    given = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, len(args))
    for k, arg in enumerate(args):
        given[k] = arg
    return given


def send(pieces: DataFrame, columns: int, size: int) -> Any:
    """Broadcast of a table from its pieces ``x, label, fold, row``; a bin takes so many bytes."""
    spark = pieces.sparkSession
    grower = loader(spark).loadClass("tablelearn.Grower")
    read = next(m for m in grower.getMethods() if m.getName() == "read")
    return read.invoke(None, _given(spark, pieces._jdf, spark.sparkContext._jsc, columns, size))


def grown(tasks: DataFrame, sent: Any, whole, real, jobs, poisson, bins, group: int, keep: bool) -> DataFrame:
    """Rows of ``ROWS`` of all jobs, whose numbers are the rows of ``tasks``.

    With ``keep`` there is a row per tree, with its columns, bins and values by node and its gains by column; else one per
    job, with the numbers, labels and margins of the rows of its fold.
    """
    spark = tasks.sparkSession
    grower = loader(spark).loadClass("tablelearn.Grower")
    numbers = [np.asarray(v, dtype=k).tobytes() for v, k in ((whole, "<i8"), (real, "<f8"), (jobs, "<i8"), (poisson, "<f8"), (bins, "<i8"))]
    made = grower.getConstructors()[0].newInstance(_given(spark, *numbers, group, keep, sent))
    schema = spark._jsparkSession.parseDataType(T._parse_datatype_string(ROWS).json())
    rows = tasks._jdf.javaRDD().flatMap(made)
    return DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark)
