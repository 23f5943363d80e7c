"""What a training job should do, with defaults and checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

TASKS = ("classification", "regression")

# What is said about settings that cannot run.
NO_NAME = "Pipeline name is required"
NO_SOURCE = "Data source is required"
NO_TARGET = "Target column is required"
BAD_TEST_SIZE = "test_size must be between 0 and 1"
BAD_VAL_SIZE = "val_size must be between 0 and 1"
NOTHING_LEFT = "test_size and val_size must leave rows to train on"
BAD_TASK = "task_type must be 'classification' or 'regression'"
BAD_TRIALS = "n_trials must be >= 1"
INVALID = "Invalid pipeline config: "


@dataclass(frozen=True)
class FeatureSpec:
    numeric_strategy: str = "standard"
    categorical_strategy: str = "onehot"
    missing_strategy: str = "median"
    datetime_columns: list[str] = field(default_factory=list)
    interaction_columns: list[str] = field(default_factory=list)
    correlation_threshold: float = 0.95
    variance_threshold: float = 0.01
    top_k_features: int | None = None
    # "all" learns from the whole table, "train" from the training part only.
    fit_on: str = "all"


@dataclass(frozen=True)
class TrainingSpec:
    task_type: str = "classification"
    models: list[str] = field(default_factory=lambda: ["random_forest", "xgboost", "lightgbm"])
    n_trials: int = 20
    cv_folds: int = 5
    metric: str = "f1"
    parallelism: int = 2
    spaces: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass(frozen=True)
class EvaluationSpec:
    primary_metric: str = "f1"
    significance_level: float = 0.05
    min_improvement: float = 0.01
    cv_folds: int = 5
    # Fold scores come from refits on the "test" part or on the "train" part.
    cv_on: str = "test"


def _known(kind: type, raw: Mapping[str, Any]) -> dict[str, Any]:
    """Settings without those a Spark job has no use for; unknown names raise."""
    unused = {"timeout_seconds"}
    strange = set(raw) - {f.name for f in fields(kind)} - unused
    if strange:
        raise ValueError(f"Unknown settings: {sorted(strange)}")
    return {k: v for k, v in raw.items() if k not in unused}


@dataclass(frozen=True)
class JobSpec:
    name: str
    data_source: str
    target_column: str
    features: FeatureSpec = field(default_factory=FeatureSpec)
    training: TrainingSpec = field(default_factory=TrainingSpec)
    evaluation: EvaluationSpec = field(default_factory=EvaluationSpec)
    test_size: float = 0.2
    val_size: float = 0.1
    random_state: int = 42
    # Columns that name a row; without them all columns together do.
    key_columns: list[str] = field(default_factory=list)

    def problems(self) -> list[str]:
        """Everything wrong with the spec; empty if it can run."""
        sizes_fit = 0 < self.test_size < 1 and 0 <= self.val_size < 1
        checks = [
            (bool(self.name), NO_NAME),
            (bool(self.data_source), NO_SOURCE),
            (bool(self.target_column), NO_TARGET),
            (0 < self.test_size < 1, BAD_TEST_SIZE),
            (0 <= self.val_size < 1, BAD_VAL_SIZE),
            (not sizes_fit or self.test_size + self.val_size < 1, NOTHING_LEFT),
            (self.training.task_type in TASKS, BAD_TASK),
            (self.training.n_trials >= 1, BAD_TRIALS),
        ]
        return [message for passed, message in checks if not passed]

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> JobSpec:
        """Build from a parsed configuration; raises ValueError if it cannot run."""
        if not isinstance(raw, Mapping):
            raise ValueError("Config must be a mapping at the top level")
        sections = {
            "feature_config": ("features", FeatureSpec),
            "training_config": ("training", TrainingSpec),
            "evaluation_config": ("evaluation", EvaluationSpec),
        }
        values: dict[str, Any] = {"name": "", "data_source": "", "target_column": ""}
        for key, value in raw.items():
            if key in sections:
                attribute, kind = sections[key]
                values[attribute] = kind(**_known(kind, value or {}))
            else:
                values.update(_known(cls, {key: value}))
        spec = cls(**values)
        problems = spec.problems()
        if problems:
            raise ValueError(INVALID + "; ".join(problems))
        return spec
