"""Model versions, stages and the run log as Parquet tables beside saved models.

The version table is rewritten as a new snapshot on every change and read from
the newest one, so no job overwrites what it reads. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelearn.session import fit_table

NONE, STAGING, PRODUCTION, ARCHIVED = "None", "Staging", "Production", "Archived"
STAGES = (NONE, STAGING, PRODUCTION, ARCHIVED)

VERSIONS = (
    "name string, version long, stage string, run_id string, metrics map<string,double>, "
    "params map<string,string>, columns array<string>, path string, created_at timestamp"
)
RUNS = (
    "run_id string, name string, status string, started_at timestamp, ended_at timestamp, "
    "metrics map<string,double>, error string"
)


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version per name and stage, by number; a null stage counts as None."""
    return (
        versions.withColumn("stage", F.coalesce("stage", F.lit(NONE)))
        .groupBy("name", "stage")
        .agg(F.max("version").alias("version"), F.max_by("run_id", "version").alias("run_id"))
        .select("name", "stage", "version", "run_id")
    )


def model_names(versions: DataFrame) -> DataFrame:
    return versions.select("name").distinct().orderBy("name")


def move_stage(
    versions: DataFrame, name: str, version: int, stage: str, archive_existing: bool = False
) -> DataFrame:
    """The version table after moving one version; optionally archiving the stage's holders."""
    if stage not in STAGES:
        raise ValueError(f"Unknown stage: {stage}")
    mine = F.col("name") == name
    changed = F.when(mine & (F.col("version") == version), F.lit(stage))
    if archive_existing:
        changed = changed.when(mine & (F.col("stage") == stage), F.lit(ARCHIVED))
    return versions.withColumn("stage", changed.otherwise(F.col("stage")))


def promote_newest(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """The version table after every model's newest version met its champion.

    ``decisions`` has ``name, should_promote``. Without a champion the newest
    version takes Production; if it won it does too and the old champion is
    archived; otherwise it waits in Staging. Names without a decision stay.
    """
    per_name = versions.groupBy("name").agg(
        F.max("version").alias("__newest"),
        F.max_by(F.coalesce("stage", F.lit(NONE)), "version").alias("__newest_stage"),
        F.count_if(F.col("stage") == PRODUCTION).alias("__holders"),
    )
    facts = fit_table(per_name.join(decisions.select("name", "should_promote"), "name"))
    newest = F.col("version") == F.col("__newest")
    champions = F.col("__holders") - (F.col("__newest_stage") == PRODUCTION).cast("int")
    wins = (champions == 0) | F.col("should_promote")
    stage = (
        F.when(F.col("should_promote").isNull(), F.col("stage"))
        .when(newest, F.when(wins, F.lit(PRODUCTION)).otherwise(F.lit(STAGING)))
        .when((F.col("stage") == PRODUCTION) & wins, F.lit(ARCHIVED))
        .otherwise(F.col("stage"))
    )
    return versions.join(facts.hinted(), "name", "left").withColumn("stage", stage).select(*versions.columns)


class Registry:
    """Saved models under ``folder`` with their versions and stages."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def _snapshots(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(VERSIONS + ", snapshot long").parquet(f"{self.folder}/versions")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def _newest(self) -> tuple[int, DataFrame]:
        stored = self._snapshots()
        if stored is None:
            return 0, self.spark.createDataFrame([], VERSIONS)
        newest = stored.agg(F.max("snapshot")).first()[0]
        return newest, stored.where(F.col("snapshot") == newest).drop("snapshot")

    def versions(self) -> DataFrame:
        return self._newest()[1]

    def _write(self, versions: DataFrame, after: int) -> None:
        path = f"{self.folder}/versions/snapshot={after + 1}"
        versions.coalesce(1).write.mode("error").parquet(path)

    def register(
        self,
        model: PipelineModel,
        name: str,
        metrics: Mapping[str, float] | None = None,
        params: Mapping[str, Any] | None = None,
        columns: list[str] | None = None,
        run_id: str | None = None,
    ) -> str:
        """Save a model, with its preprocessing inside, as the next version of ``name``."""
        run_id = run_id or uuid.uuid4().hex
        snapshot, versions = self._newest()
        last = versions.where(F.col("name") == name).agg(F.max("version")).first()[0] or 0
        path = f"{self.folder}/models/{name}/version={last + 1}-{run_id}"
        model.write().save(path)
        row = (
            name,
            last + 1,
            NONE,
            run_id,
            {k: float(v) for k, v in (metrics or {}).items()},
            {k: str(v) for k, v in (params or {}).items()},
            columns,
            path,
            datetime.now(timezone.utc),
        )
        self._write(versions.unionByName(self.spark.createDataFrame([row], VERSIONS)), snapshot)
        return run_id

    def version_of(self, name: str, run_id: str) -> int | None:
        found = self.versions().where((F.col("name") == name) & (F.col("run_id") == run_id))
        return found.agg(F.max("version")).first()[0]

    def set_stage(self, name: str, version: int, stage: str = PRODUCTION, archive_existing: bool = False) -> None:
        snapshot, versions = self._newest()
        self._write(move_stage(versions, name, version, stage, archive_existing), snapshot)

    def list_models(self) -> DataFrame:
        return latest_versions(self.versions()).orderBy("name", "stage")

    def _row(self, name: str, condition) -> Any:
        found = self.versions().where((F.col("name") == name) & condition)
        return found.orderBy(F.desc("version")).limit(1).first()

    def production(self, name: str) -> Any:
        """Row of the current champion, or None."""
        return self._row(name, F.col("stage") == PRODUCTION)

    def load_production(self, name: str) -> PipelineModel:
        row = self.production(name)
        if row is None:
            raise LookupError(f"no production model named {name}")
        return PipelineModel.load(row["path"])

    def load_version(self, name: str, version: int) -> PipelineModel:
        row = self._row(name, F.col("version") == version)
        if row is None:
            raise LookupError(f"no version {version} of model {name}")
        return PipelineModel.load(row["path"])


# ---------------------------------------------------------------- run log


def run_history(runs: DataFrame, name: str | None = None) -> DataFrame:
    """Runs of one job, or all, oldest first."""
    chosen = runs if name is None else runs.where(F.col("name") == name)
    return chosen.orderBy("started_at", "run_id")


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs per job and status with the time of the last one and its run id."""
    return runs.groupBy("name", "status").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max("started_at").alias("last_started_at"),
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("last_run_id"),
    )


class RunLog:
    """Append-only Parquet table of job and candidate runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.path = f"{str(folder).rstrip('/')}/runs"

    def append(
        self,
        name: str,
        status: str,
        started_at: datetime,
        metrics: Mapping[str, float] | None = None,
        error: str | None = None,
        run_id: str | None = None,
    ) -> str:
        run_id = run_id or uuid.uuid4().hex
        values = {k: float(v) for k, v in (metrics or {}).items()}
        row = (run_id, name, status, started_at, datetime.now(timezone.utc), values, error)
        self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(self.path)
        return run_id

    def history(self, name: str | None = None) -> DataFrame:
        try:
            runs = self.spark.read.schema(RUNS).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            runs = self.spark.createDataFrame([], RUNS)
        return run_history(runs, name)
