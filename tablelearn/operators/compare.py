"""Ranking, significance, recommendations and promotion decisions over metric tables.

All inputs here are long tables with one row per model and metric (or fold).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tablelearn.functions import metrics
from tablelearn.functions.columns import divide, quoted
from tablelearn.functions.student import two_sided_p

# Recommendation texts and their limits.
LOW_F1 = "F1 score is low — consider more feature engineering or data collection"
GAP = "Large precision-recall gap — consider adjusting classification threshold"
LOW_AUC = "AUC-ROC is low — model has weak discriminative ability"
LOW_R2 = "R2 is low — model explains little variance; try non-linear models"
HIGH_MAPE = "MAPE > 30% — predictions have large relative error"

# The sentence on the winner and the reasons for a promotion.
WINNER = "Best model: {model} ({metric}={value:.4f}, CV mean={mean:.4f} +/- {std:.4f})"
BETTER = ". Statistically significantly better than {other} (p={p:.4f})."
NOT_BETTER = ". NOT statistically significantly better than {other} (p={p:.4f}); consider the simpler model."
IMPROVES = "New model improves by %.4f ({direction})"
TOO_LITTLE = "New model does not improve sufficiently (delta=%.4f, threshold={limit})"
HIGHER, LOWER = "higher is better", "lower is better"


def rank_models(scores: DataFrame, primary: str) -> DataFrame:
    """``model, position, score, rank`` by the primary metric; ties keep input order.

    ``scores`` has ``model, position, metric, value``. A model without the
    metric scores 0. Error metrics rank upwards, all others downwards.
    """
    one = scores.groupBy("model").agg(
        F.min("position").alias("position"),
        F.coalesce(F.max(F.when(F.col("metric") == primary, F.col("value"))), F.lit(0.0)).alias("score"),
    )
    best = F.asc("score") if primary in metrics.LOWER_IS_BETTER else F.desc("score")
    # One row per model: a handful, so the unpartitioned window is harmless.
    return one.withColumn("rank", F.row_number().over(Window.orderBy(best, "position")))


def best_model(scores: DataFrame, primary: str) -> DataFrame:
    return rank_models(scores, primary).where("rank = 1")


def comparison_table(
    scores: DataFrame, primary: str, names: Sequence[str], times: DataFrame | None = None
) -> DataFrame:
    """``rank, model``, one column per metric, and ``training_time`` if given."""
    wide = scores.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))
    table = rank_models(scores, primary).select("rank", "model").join(wide, "model")
    columns = ["rank", "model", *names]
    if times is not None:
        table = table.join(times, "model", "left")
        columns.append("training_time")
    return table.select(*columns)


def paired_t_test(folds: DataFrame, ranking: DataFrame, level: float = 0.05) -> DataFrame:
    """Paired t-test between the first two models on their common folds.

    ``folds`` has ``model, fold, score``; ``ranking`` has ``model, rank``. One
    row; without two models none. With fewer than two common folds ``test`` is
    ``insufficient_data``. Scores that never differ give no t and no p.
    """
    top = ranking.where("rank <= 2").select("model", "rank")
    sides = folds.join(F.broadcast(top), "model").groupBy("fold").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"),
    )
    d = F.col("a") - F.col("b")
    sums = sides.where("a is not null and b is not null").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std")
    )
    names = top.agg(
        F.max(F.when(F.col("rank") == 1, F.col("model"))).alias("model_a"),
        F.max(F.when(F.col("rank") == 2, F.col("model"))).alias("model_b"),
    ).where("model_b is not null")
    # A constant non-zero difference is infinitely significant.
    certain = F.when((F.col("std") == 0) & (F.col("mean") != 0), F.signum("mean") * F.lit(float("inf")))
    t = F.coalesce(divide(F.col("mean"), F.col("std") / F.sqrt(F.col("n").cast("double"))), certain)
    enough = F.col("n") >= 2
    # Two one-row tables side by side.
    row = names.withColumn("__one", F.lit(1)).join(sums.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return (
        row.withColumn("t_statistic", F.when(enough, t))
        .withColumn("p_value", two_sided_p(F.col("t_statistic"), F.col("n") - 1))
        .select(
            F.when(enough, "paired_t_test").otherwise("insufficient_data").alias("test"),
            "model_a",
            "model_b",
            F.col("n").alias("n_folds"),
            "t_statistic",
            "p_value",
            F.when(enough, F.coalesce(F.col("p_value") < level, F.lit(False))).alias("significant"),
        )
    )


def recommendations(scores: DataFrame, task: str) -> DataFrame:
    """``model, recommendation`` rows from ``model, metric, value``."""

    def value(name: str, default: float):
        return F.coalesce(F.max(F.when(F.col("metric") == name, F.col("value"))), F.lit(default)).alias(name)

    if task == "classification":
        one = scores.groupBy("model").agg(
            value("f1", 0.0), value("precision", 0.0), value("recall", 0.0), value("auc_roc", 1.0)
        )
        gap = (F.col("precision") > 0) & (F.col("recall") > 0) & (F.abs(F.col("precision") - F.col("recall")) > 0.15)
        rules = [(F.col("f1") < 0.6, LOW_F1), (gap, GAP), (F.col("auc_roc") < 0.7, LOW_AUC)]
    else:
        one = scores.groupBy("model").agg(value("r2", 0.0), value("mape", 0.0))
        rules = [(F.col("r2") < 0.5, LOW_R2), (F.col("mape") > 0.3, HIGH_MAPE)]
    told = F.filter(F.array(*[F.when(holds, F.lit(text)) for holds, text in rules]), lambda r: r.isNotNull())
    return one.select("model", F.explode(told).alias("recommendation"))


def summary_text(
    model: str, primary: str, value: float, cv_mean: float, cv_std: float, test: dict | None
) -> str:
    """The sentence that names the winner and says how sure the choice is."""
    text = WINNER.format(model=model, metric=primary, value=value, mean=cv_mean, std=cv_std)
    if not test or test.get("test") != "paired_t_test":
        return text
    p = test["p_value"] if test["p_value"] is not None else float("nan")
    return text + (BETTER if test["significant"] else NOT_BETTER).format(other=test["model_b"], p=p)


SIDES = ("new", "current")


def promotion_decision(
    df: DataFrame, label: str, new: str, current: str, task: str = "classification", min_improvement: float = 0.01
) -> DataFrame:
    """Champion against challenger on the same rows, from two prediction columns."""
    sides = [F.struct(F.lit(s).alias("side"), quoted(c).alias("prediction")) for s, c in zip(SIDES, (new, current))]
    stacked = df.select(quoted(label).alias("label"), F.inline(F.array(*sides)))
    return decide_promotion(stacked, task, min_improvement)


def decide_promotion(stacked: DataFrame, task: str = "classification", min_improvement: float = 0.01) -> DataFrame:
    """The decision from ``side, label, prediction`` rows with side new or current.

    Classification compares weighted F1, regression the mean squared error. One
    row: ``should_promote, improvement, current_score, new_score, reason``.
    """
    if task == "classification":
        scores = metrics.classification_wide(stacked, "label", "prediction", ["side"]).withColumnRenamed("f1", "s")
        sign, direction = 1, HIGHER
    else:
        scores = metrics.regression_wide(stacked, "label", "prediction", ["side"]).withColumnRenamed("mse", "s")
        sign, direction = -1, LOWER
    row = scores.agg(
        F.max(F.when(F.col("side") == "new", F.col("s"))).alias("new_score"),
        F.max(F.when(F.col("side") == "current", F.col("s"))).alias("current_score"),
    ).withColumn("improvement", sign * (F.col("new_score") - F.col("current_score")))
    gain = F.col("improvement")
    better = gain >= F.lit(min_improvement)
    said = F.when(better, F.format_string(IMPROVES.format(direction=direction), gain)).otherwise(
        F.format_string(TOO_LITTLE.format(limit=min_improvement), gain)
    )
    return row.select(better.alias("should_promote"), "improvement", "current_score", "new_score", said.alias("reason"))
