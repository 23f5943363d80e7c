"""Model families: a name and parameters in, a Spark ML estimator out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from random import Random
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.operators.features import JsonStage
from tablelearn.operators.logistic import LogisticPlan
from tablelearn.operators.trees import FEATURES, LABEL, TreeFit, TreePlan

# Values of a column that trees may split at, unless ``max_bins`` says otherwise.
BINS = 256


# ---------------------------------------------------------------- search spaces


@dataclass(frozen=True)
class Uniform:
    """Real number in [low, low + width)."""

    low: float
    width: float

    def draw(self, random: Random) -> float:
        return self.low + self.width * random.random()


@dataclass(frozen=True)
class Whole:
    """Whole number from low up to, but not including, high."""

    low: int
    high: int

    def draw(self, random: Random) -> int:
        return random.randrange(self.low, self.high)


Space = dict[str, Any]

# The default search spaces. A list means "one of these".
FOREST_SPACE: Space = {
    "n_estimators": Whole(50, 300),
    "max_depth": [None, 5, 10, 20, 30],
    "min_samples_split": Whole(2, 20),
    "min_samples_leaf": Whole(1, 10),
}
XGBOOST_SPACE: Space = {
    "n_estimators": Whole(50, 300),
    "max_depth": Whole(3, 10),
    "learning_rate": Uniform(0.01, 0.3),
    "subsample": Uniform(0.6, 0.4),
    "colsample_bytree": Uniform(0.6, 0.4),
}
LIGHTGBM_SPACE: Space = {
    "n_estimators": Whole(50, 300),
    "max_depth": Whole(3, 10),
    "learning_rate": Uniform(0.01, 0.3),
    "num_leaves": Whole(20, 100),
    "subsample": Uniform(0.6, 0.4),
}
LOGISTIC_SPACE: Space = {"C": Uniform(0.01, 10), "penalty": ["l2"], "solver": ["lbfgs"], "max_iter": [500, 1000]}

SPACES: dict[str, dict[str, Space]] = {
    "classification": {
        "logistic_regression": LOGISTIC_SPACE,
        "random_forest": FOREST_SPACE,
        "xgboost": XGBOOST_SPACE,
        "lightgbm": LIGHTGBM_SPACE,
    },
    "regression": {
        "linear_regression": {},
        "random_forest": FOREST_SPACE,
        "xgboost": XGBOOST_SPACE,
        "lightgbm": LIGHTGBM_SPACE,
    },
}


def search_space(task: str, model: str, custom: Mapping[str, Space] | None = None) -> Space:
    """A custom space if there is one, else the default; unknown models have none."""
    return (custom or {}).get(model, SPACES[task].get(model, {}))


def all_spaces(task: str, custom: Mapping[str, Space] | None = None) -> dict[str, Space]:
    return {**SPACES[task], **(custom or {})}


def sample_params(space: Space, trials: int, seed: int) -> list[dict[str, Any]]:
    """Distinct random draws from a space; fewer if the space holds fewer."""
    random = Random(seed)
    draws: list[dict[str, Any]] = []
    for _ in range(20 * trials):
        if len(draws) == trials:
            break
        draw = {k: random.choice(v) if isinstance(v, (list, tuple)) else v.draw(random) for k, v in space.items()}
        if draw not in draws:
            draws.append(draw)
    return draws


# ---------------------------------------------------------------- families


@dataclass(frozen=True)
class Shape:
    """What a family must know about the training data."""

    task: str
    rows: int
    classes: int = 0
    seed: int = 42


def logistic(params: Mapping[str, Any], shape: Shape) -> Estimator:
    # The objective here is a mean, not a sum, hence the row count in the penalty.
    penalty = 1.0 / (params.get("C", 1.0) * max(shape.rows, 1))
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        regParam=penalty,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=params.get("max_iter", 100),
        tol=params.get("tol", 1e-6),
    )


def linear(params: Mapping[str, Any], shape: Shape) -> Estimator:
    # The normal equations fit in one pass but take at most 4,096 columns; beyond, the
    # steps go on until the fit is the same to many digits.
    return LinearRegression(
        featuresCol=FEATURES, labelCol=LABEL, **{"solver": "auto", "regParam": 0.0, "tol": 1e-12, "maxIter": 1000, **params}
    )


def forest_plan(params: Mapping[str, Any], shape: Shape) -> TreePlan:
    """Splits of a regression tree may use any column, of a class tree the root of their number."""
    return TreePlan(
        boosted=False,
        classes=shape.classes if shape.task == "classification" else 0,
        trees=params.get("n_estimators", 100),
        max_depth=params.get("max_depth"),
        min_split=params.get("min_samples_split", 2),
        min_leaf=params.get("min_samples_leaf", 1),
        bootstrap=params.get("bootstrap", True),
        root_columns=shape.task == "classification",
        bins=params.get("max_bins", BINS),
        seed=shape.seed,
    )


def _boosted(params: Mapping[str, Any], shape: Shape, rate: float, **settings: Any) -> TreePlan:
    return TreePlan(
        boosted=True,
        classes=shape.classes if shape.task == "classification" else 0,
        trees=params.get("n_estimators", 100),
        rate=params.get("learning_rate", rate),
        subsample=params.get("subsample", 1.0),
        penalty=params.get("reg_lambda", 0.0),
        bins=params.get("max_bins", BINS),
        seed=shape.seed,
        **settings,
    )


def depth_plan(params: Mapping[str, Any], shape: Shape) -> TreePlan:
    """Gradient boosting that samples columns per tree and limits depth."""
    return _boosted(
        params, shape, 0.3, max_depth=params.get("max_depth", 6), tree_columns=float(params.get("colsample_bytree", 1.0))
    )


def leaves_plan(params: Mapping[str, Any], shape: Shape) -> TreePlan:
    """Gradient boosting whose trees grow best leaf first up to a number of leaves."""
    return _boosted(params, shape, 0.1, max_depth=params.get("max_depth"), max_leaves=params.get("num_leaves", 31))


# Families of trees: their fits of one table are made together.
TREE_PLANS: dict[str, Callable[[Mapping[str, Any], Shape], TreePlan]] = {
    "random_forest": forest_plan,
    "xgboost": depth_plan,
    "lightgbm": leaves_plan,
}


def forest(params: Mapping[str, Any], shape: Shape) -> Estimator:
    return TreeFit(forest_plan(params, shape))


def boosted_by_depth(params: Mapping[str, Any], shape: Shape) -> Estimator:
    return TreeFit(depth_plan(params, shape))


def boosted_by_leaves(params: Mapping[str, Any], shape: Shape) -> Estimator:
    return TreeFit(leaves_plan(params, shape))


Family = Callable[[Mapping[str, Any], Shape], Estimator]

FAMILIES: dict[str, dict[str, Family]] = {
    "classification": {
        "logistic_regression": logistic,
        "random_forest": forest,
        "xgboost": boosted_by_depth,
        "lightgbm": boosted_by_leaves,
    },
    "regression": {
        "linear_regression": linear,
        "random_forest": forest,
        "xgboost": boosted_by_depth,
        "lightgbm": boosted_by_leaves,
    },
}


def add_family(task: str, name: str, family: Family, space: Space | None = None) -> None:
    """Make a new model family available by name."""
    FAMILIES[task][name] = family
    SPACES[task][name] = dict(space or {})


def tree_plan(task: str, name: str, params: Mapping[str, Any], shape: Shape) -> TreePlan | None:
    """The plan of a fit if the family of that name is one of trees (and was not replaced by another)."""
    own = {"random_forest": forest, "xgboost": boosted_by_depth, "lightgbm": boosted_by_leaves}
    return TREE_PLANS[name](params, shape) if name in own and FAMILIES[task].get(name) is own[name] else None


def logistic_plan(task: str, name: str, params: Mapping[str, Any], shape: Shape, fold: int) -> LogisticPlan | None:
    """The settings of a logistic fit without a fold, if the family of that name is it (and was not replaced)."""
    if FAMILIES[task].get(name) is not logistic:
        return None
    fit = logistic(params, shape)
    return LogisticPlan(fold, fit.getRegParam(), fit.getMaxIter(), fit.getTol())


def estimator(task: str, name: str, params: Mapping[str, Any], shape: Shape) -> Estimator:
    if name not in FAMILIES[task]:
        raise ValueError(f"Unknown {task} model: {name}")
    return FAMILIES[task][name](params, shape)


# ---------------------------------------------------------------- probabilities


class ClassProbabilities(JsonStage):
    """Class probabilities as a plain array, whatever the model offers.

    One-vs-rest boosting gives margins only: each becomes a probability by the
    logistic link of boosted trees, then the classes are scaled to sum to one.
    """

    def __init__(self, out: str = "probabilities"):
        super().__init__(out=out)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.known["out"]
        if "probability" in df.columns:
            return df.withColumn(out, vector_to_array("probability"))
        if "rawPrediction" in df.columns:
            return df.withColumn(out, _from_margins(vector_to_array("rawPrediction")))
        return df.withColumn(out, F.lit(None).cast("array<double>"))


def _from_margins(margins: Column) -> Column:
    linked = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(linked, F.lit(0.0), lambda a, x: a + x)
    return F.transform(linked, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))
