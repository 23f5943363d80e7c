"""Exact classification and regression metrics as distributed aggregates.

Every function takes ``by`` columns, so the predictions of many models or
folds can be stacked in one table and measured in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import divide, quoted
from tablelearn.functions.ordering import running_totals
from tablelearn.session import fit_table

# Smallest denominator of a relative error: double precision's unit step.
EPSILON = 2.220446049250313e-16

CLASSIFICATION = ("accuracy", "precision", "recall", "f1")
REGRESSION = ("mae", "mse", "rmse", "r2", "mape")
LOWER_IS_BETTER = {"mae", "mse", "rmse", "mape"}

# Metrics a user adds: name -> function of (label, prediction) columns giving an aggregate.
CUSTOM: dict[str, Callable[[Column, Column], Column]] = {}


def add_metric(name: str, aggregate: Callable[[Column, Column], Column], lower_is_better: bool = False) -> None:
    """Make an extra aggregate part of ``regression`` and ``classification`` tables, ranked by its direction."""
    CUSTOM[name] = aggregate
    (LOWER_IS_BETTER.add if lower_is_better else LOWER_IS_BETTER.discard)(name)


def pair_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """How often each (label, prediction) pair occurs; all class metrics follow."""
    return df.groupBy(*by, quoted(label).alias("label"), quoted(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix in long form, zero cells included.

    Cells: the sorted union of true and predicted classes, on both sides. The
    grid comes from the class list, whose square is the size of the answer.
    """
    seen = fit_table(pair_counts(df, label, prediction, by))
    classes = F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("prediction")))
    grid = (
        seen.df.groupBy(*by)
        .agg(classes.alias("classes"))
        .select(*by, "classes", F.explode("classes").alias("label"))
        .select(*by, "label", F.explode("classes").alias("prediction"))
    )
    return grid.join(seen.hinted(), [*by, "label", "prediction"], "left").select(
        *by, "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def class_report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 of every class; 0/0 counts as 0."""
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("hits"),
        ),
    )
    totals = (
        pair_counts(df, label, prediction, by)
        .select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.class")
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hits").alias("hits"))
    )
    zero = F.lit(0.0)
    return totals.select(
        *by,
        "class",
        "support",
        "hits",
        F.coalesce(divide(F.col("hits"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(divide(F.col("hits"), F.col("support")), zero).alias("recall"),
        F.coalesce(divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), zero).alias("f1"),
    )


def classification_wide(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy and support-weighted precision, recall and F1, one row per group."""
    report = class_report(df, label, prediction, by)
    rows = F.sum("support")

    def weighted(name: str) -> Column:
        return divide(F.sum(F.col(name) * F.col("support")), rows).alias(name)

    return report.groupBy(*by).agg(
        divide(F.sum("hits"), rows).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1")
    )


def regression_wide(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """mae, mse, rmse, r2 and mape, one row per group and one pass.

    r2 of a constant label is 1 if every prediction is right, else 0. mape
    divides by at least EPSILON, so a zero label never raises.
    """
    y, p = quoted(label).cast("double"), quoted(prediction).cast("double")
    e = y - p
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("spread"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
    flat = F.when(F.col("mse") == 0, 1.0).when(F.col("mse").isNotNull(), 0.0)
    r2 = F.coalesce(1 - divide(F.col("mse"), F.col("spread")), flat)
    return sums.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mape")


def to_long(wide: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``metric, value`` rows from one column per metric."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    return wide.select(*by, F.inline(F.array(*cells)))


def auc(df: DataFrame, label: str, score: str, positive, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; column ``auc_roc``.

    NULL for a group that lacks positive or negative rows.
    """
    rows = df.select(
        *by, quoted(score).cast("double").alias("score"), (quoted(label) == F.lit(positive)).cast("long").alias("pos")
    )
    return _auc(rows, by)


def _auc(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area per ``by`` group of ``score, pos`` rows; also the positive count."""
    tied = rows.groupBy(*by, "score").agg(
        F.sum("pos").cast("long").alias("pos"), F.sum(1 - F.col("pos")).cast("long").alias("neg")
    )
    # Sorted by group and score; a group's own start is taken off again below.
    ranked = running_totals(tied, [*by, "score"], ["neg"])
    won = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    area = ranked.groupBy(*by).agg(
        F.sum(won).alias("won"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.min("before_neg").alias("start"),
    )
    wins = F.col("won") - F.col("pos") * F.col("start")
    return area.select(
        *by,
        divide(wins, F.col("pos").cast("double") * F.col("neg")).alias("auc_roc"),
        F.col("pos").alias("positives"),
    )


def auc_one_vs_rest(
    df: DataFrame, label: str, probabilities: str, classes: Sequence, by: Sequence[str] = ()
) -> DataFrame:
    """Per-class AUC weighted by class frequency.

    ``probabilities`` is an array aligned with ``classes``. If a class has no
    rows the value is NULL, since its curve does not exist.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("class_no"),
                F.element_at(quoted(probabilities), i + 1).cast("double").alias("score"),
                (quoted(label) == F.lit(c)).cast("long").alias("pos"),
            )
            for i, c in enumerate(classes)
        ]
    )
    rows = df.select(*by, F.inline(cells))
    per_class = _auc(rows, [*by, "class_no"])
    whole = F.count("auc_roc") == F.lit(len(classes))
    return per_class.groupBy(*by).agg(
        F.when(whole, divide(F.sum(F.col("auc_roc") * F.col("positives")), F.sum("positives"))).alias("auc_roc")
    )


def classification(
    df: DataFrame,
    label: str,
    prediction: str,
    probabilities: str | None = None,
    classes: Sequence | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Long table of all classification metrics; AUC only if scores are given."""
    wide = classification_wide(df, label, prediction, by)
    out = to_long(wide, CLASSIFICATION, by)
    if probabilities is not None and classes is not None and len(classes) >= 2:
        if len(classes) == 2:
            scored = df.select(
                *by, quoted(label).alias("label"), F.element_at(quoted(probabilities), 2).alias("score")
            )
            area = auc(scored, "label", "score", classes[1], by)
        else:
            area = auc_one_vs_rest(df, label, probabilities, classes, by)
        out = out.unionByName(to_long(area, ["auc_roc"], by).where("value is not null"))
    return out.unionByName(_custom(df, label, prediction, by)) if CUSTOM else out


def regression(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    out = to_long(regression_wide(df, label, prediction, by), REGRESSION, by)
    return out.unionByName(_custom(df, label, prediction, by)) if CUSTOM else out


def evaluate(df: DataFrame, task: str, label: str, prediction: str, **scores) -> DataFrame:
    """Classification metrics for that task, regression metrics for any other."""
    if task == "classification":
        return classification(df, label, prediction, **scores)
    return regression(df, label, prediction, scores.get("by", ()))


def _custom(df: DataFrame, label: str, prediction: str, by: Sequence[str]) -> DataFrame:
    wide = df.groupBy(*by).agg(
        *[build(quoted(label), quoted(prediction)).alias(name) for name, build in CUSTOM.items()]
    )
    return to_long(wide, list(CUSTOM), by)


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Label minus prediction as a column of the same table."""
    return df.withColumn("residual", quoted(label).cast("double") - quoted(prediction).cast("double"))


def fold_summary(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population std of fold scores; 0 where there are none."""
    return scores.groupBy(*by).agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("cv_mean"),
        F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("cv_std"),
    )
