"""Session set-up, the shared work folder, and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.storagelevel import StorageLevel

from tablelearn.functions.columns import quoted

# A table is small, and so may be broadcast, only within both bounds.
SMALL_ROWS = 20_000
ROW_BYTES = 2_048


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablelearn")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only when nothing is configured and the session
    runs on one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablelearn-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_folder(spark)}/tablelearn-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later actions and lost executors read the stored copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder and read back, with columnar pruning kept."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Workspace:
    """Stored intermediate tables of one job, deleted when the job is over."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = scratch_path(spark, "job")

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class FittedTable:
    """A learned table; ``local`` holds its rows if its size was proven to be small."""

    df: DataFrame
    local: pa.Table | None = None

    @property
    def small(self) -> bool:
        return self.local is not None

    def hinted(self) -> DataFrame:
        """The table, marked for broadcast only if it is known to be small."""
        return F.broadcast(self.df) if self.small else self.df

    def total(self, column: str) -> int:
        if self.local is not None:
            return pc.sum(self.local[column]).as_py() or 0
        return self.df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]

    def rows(self) -> list[dict]:
        """Rows of a small table on the driver."""
        if self.local is None:
            raise ValueError("only a table proven small may be brought to the driver")
        return self.local.to_pylist()


def local_table(spark: SparkSession, rows: pa.Table, schema: T.StructType | str) -> FittedTable:
    """A small table from rows already on the driver."""
    return FittedTable(spark.createDataFrame(rows, schema=schema), rows)


def fit_table(df: DataFrame, max_rows: int | None = None) -> FittedTable:
    """Compute ``df`` and keep the result.

    A small result becomes a local table whose plan no longer refers to the
    source. Any other is checkpointed and stays distributed. At most ``max_rows``
    (by default SMALL_ROWS) + 1 rows of at most ``ROW_BYTES`` reach the driver: wider rows
    are blanked before they are sent, and only show that the table is not small.
    """
    width = sum(
        (F.coalesce(F.octet_length(quoted(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0)
    )
    wide = width > ROW_BYTES
    max_rows = SMALL_ROWS if max_rows is None else max_rows
    # Kept between the two steps, so that a large table is computed only once.
    computed = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = (
            computed.limit(max_rows + 1)
            .select(wide.alias("__wide"), *[F.when(~wide, quoted(c)).alias(c) for c in df.columns])
            .toArrow()
        )
        if found.num_rows <= max_rows and not pc.any(found["__wide"]).as_py():
            return local_table(df.sparkSession, found.drop_columns(["__wide"]), _nullable(df.schema))
        return FittedTable(cut_lineage(computed))
    finally:
        computed.unpersist()


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
