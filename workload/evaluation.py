"""Metrics, ranking, significance, promotion and the model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelearn.functions import metrics
from tablelearn.operators import compare
from tablelearn.operators.splits import k_folds
from tablelearn.plans.registry import latest_versions, model_names, move_stage, promote_newest, run_summary
from workload import query
from workload.inputs import (
    ESTIMATED_PRICES,
    JUDGED_DOCUMENTS,
    estimated_prices,
    judged_documents,
    rounded,
    table,
)


def class_metrics_sql(source: str, label: str, prediction: str) -> str:
    """Common table expression ``m``: accuracy and weighted precision, recall and F1."""
    return f"""pairs AS (SELECT {label} AS y, {prediction} AS p FROM {source}),
classes AS (SELECT y AS c FROM pairs UNION SELECT p FROM pairs),
per_class AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS predicted,
                     count(*) FILTER (y = c AND p = c) AS hits FROM pairs, classes GROUP BY c),
shares AS (SELECT support, hits, coalesce(hits / nullif(predicted, 0), 0) AS prec,
                  coalesce(hits / nullif(support, 0), 0) AS rec,
                  coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f FROM per_class),
m AS (SELECT sum(hits) / sum(support) AS accuracy, sum(prec * support) / sum(support) AS "precision",
             sum(rec * support) / sum(support) AS recall, sum(f * support) / sum(support) AS f1 FROM shares)"""


def auc_sql(source: str, label: str, score: str) -> str:
    """Area under the curve from average ranks."""
    return f"""(SELECT (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2)
       / (count(*) FILTER (pos) * count(*) FILTER (NOT pos))
FROM (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r
      FROM (SELECT {label} AS pos, {score} AS s FROM {source})))"""


_LONG = """SELECT u.metric AS metric, round(u.v, 6) + 0.0 AS value FROM m, LATERAL (VALUES
  ('accuracy', accuracy), ('precision', "precision"), ('recall', recall), ('f1', f1)"""


@query(
    f"""WITH {JUDGED_DOCUMENTS}, {class_metrics_sql("judged", "quality", "long_rule")}
{_LONG}, ('auc_roc', {auc_sql("judged", "quality = 1", "score")})) AS u(metric, v)"""
)
def classification_metrics(spark, folder):
    df = judged_documents(spark, folder).withColumn("scores", F.array(1 - F.col("score"), F.col("score")))
    return rounded(metrics.classification(df, "quality", "long_rule", "scores", [0, 1]))


@query(
    f"""WITH {JUDGED_DOCUMENTS}, classes AS (SELECT quality AS c FROM judged UNION SELECT long_rule FROM judged)
SELECT a.c AS label, b.c AS prediction, count(doc_id) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN judged ON quality = a.c AND long_rule = b.c GROUP BY a.c, b.c"""
)
def confusion_matrix(spark, folder):
    return metrics.confusion(judged_documents(spark, folder), "quality", "long_rule")


_GUESS = """guessed AS (SELECT doc_id, lang, ['de', 'en', 'es', 'fr', 'it'][1 + n_chars % 5] AS guess,
  [((n_chars * 3) % 97) / 97.0::DOUBLE, ((n_chars * 5) % 97) / 97.0::DOUBLE, ((n_chars * 7) % 97) / 97.0::DOUBLE,
   ((n_chars * 11) % 97) / 97.0::DOUBLE] AS scores FROM documents)"""


def _guessed(spark, folder):
    n = F.col("n_chars")
    choices = F.array(*[F.lit(c) for c in ("de", "en", "es", "fr", "it")])
    scores = F.array(*[(n * k % 97) / F.lit(97.0) for k in (3, 5, 7, 11)])
    return table(spark, folder, "documents").select(
        "doc_id", "lang", F.element_at(choices, (1 + n % 5).cast("int")).alias("guess"), scores.alias("scores")
    )


@query(
    f"""WITH {_GUESS}, classes AS (SELECT lang AS c FROM guessed UNION SELECT guess FROM guessed)
SELECT c AS "class", count(*) FILTER (lang = c) AS support, count(*) FILTER (lang = c AND guess = c) AS hits,
       round(coalesce(count(*) FILTER (lang = c AND guess = c) / nullif(count(*) FILTER (guess = c), 0), 0), 6) AS "precision",
       round(coalesce(count(*) FILTER (lang = c AND guess = c) / nullif(count(*) FILTER (lang = c), 0), 0), 6) AS recall,
       round(coalesce(2 * count(*) FILTER (lang = c AND guess = c)
             / nullif(count(*) FILTER (lang = c) + count(*) FILTER (guess = c), 0), 0), 6) AS f1
FROM guessed, classes GROUP BY c"""
)
def class_report(spark, folder):
    """Five predicted classes, of which one never occurs."""
    return rounded(metrics.class_report(_guessed(spark, folder), "lang", "guess"))


_CLASSES = ["de", "en", "es", "fr"]


@query(
    f"WITH {_GUESS} SELECT round(("
    + " + ".join(
        f"{auc_sql('guessed', f"lang = '{c}'", f'scores[{i}]')} * (SELECT count(*) FROM guessed WHERE lang = '{c}')"
        for i, c in enumerate(_CLASSES, 1)
    )
    + ") / (SELECT count(*) FROM guessed), 6) AS auc_roc"
)
def auc_one_vs_rest(spark, folder):
    return rounded(metrics.auc_one_vs_rest(_guessed(spark, folder), "lang", "scores", _CLASSES))


def _regression_sql(prediction: str) -> str:
    return f"""SELECT avg(abs(label - {prediction})) AS mae, avg((label - {prediction}) ** 2) AS mse,
       sqrt(avg((label - {prediction}) ** 2)) AS rmse,
       1 - sum((label - {prediction}) ** 2) / (var_pop(label) * count(*)) AS r2,
       avg(abs(label - {prediction}) / greatest(abs(label), 2.220446049250313e-16)) AS mape FROM estimated"""


@query(
    f"""WITH {ESTIMATED_PRICES}, m AS ({_regression_sql("by_quantity")})
SELECT u.metric AS metric, round(u.v, 3) AS value FROM m, LATERAL (VALUES
  ('mae', mae), ('mse', mse), ('rmse', rmse), ('r2', r2), ('mape', mape)) AS u(metric, v)"""
)
def regression_metrics(spark, folder):
    return rounded(metrics.regression(estimated_prices(spark, folder), "label", "by_quantity"), 3)


@query(
    f"""WITH {ESTIMATED_PRICES}
SELECT l_linenumber, round(avg(abs(label - flat)), 4) AS mae, round(avg((label - flat) ** 2), 1) AS mse,
       round(1 - avg((label - flat) ** 2) / var_pop(label), 6) AS r2
FROM estimated GROUP BY l_linenumber"""
)
def regression_metrics_by_group(spark, folder):
    wide = metrics.regression_wide(estimated_prices(spark, folder), "label", "flat", ["l_linenumber"])
    return wide.select(
        "l_linenumber", F.round("mae", 4).alias("mae"), F.round("mse", 1).alias("mse"), F.round("r2", 6).alias("r2")
    )


@query(f"WITH {ESTIMATED_PRICES} SELECT label, by_quantity, round(label - by_quantity, 4) + 0.0 AS residual FROM estimated")
def residuals(spark, folder):
    df = metrics.residuals(estimated_prices(spark, folder), "label", "by_quantity")
    return rounded(df.select("label", "by_quantity", "residual"), 4)


# ---------------------------------------------------------------- comparison


def _rule_scores(spark, folder):
    """Metric rows of both rules, as candidates 0 and 1."""
    judged = judged_documents(spark, folder)
    rules = [("long", "long_rule", 0), ("short", "short_rule", 1)]
    cells = [
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("position"), F.col(c).alias("prediction")) for m, c, i in rules
    ]
    stacked = judged.select("quality", F.inline(F.array(*cells)))
    return metrics.classification(stacked, "quality", "prediction", by=["model", "position"])


def _both_rules(out: str) -> str:
    one = class_metrics_sql("judged", "quality", "long_rule")
    two = class_metrics_sql("judged", "quality", "short_rule")
    return f"""WITH {JUDGED_DOCUMENTS},
rules AS (SELECT 'long' AS model, 0 AS position, (WITH {one} SELECT m FROM m) AS m
          UNION ALL SELECT 'short', 1, (WITH {two} SELECT m FROM m)),
ranked AS (SELECT model, position, m, row_number() OVER (ORDER BY m.f1 DESC, position) AS rank FROM rules)
{out}"""


@query(_both_rules("SELECT model, position, round(m.f1, 6) AS score, rank::INTEGER AS rank FROM ranked"))
def ranked_models(spark, folder):
    return rounded(compare.rank_models(_rule_scores(spark, folder), "f1"))


@query(
    _both_rules(
        """SELECT rank::INTEGER AS rank, model, round(m.accuracy, 6) AS accuracy, round(m."precision", 6) AS "precision",
       round(m.recall, 6) AS recall, round(m.f1, 6) AS f1 FROM ranked"""
    )
)
def model_comparison(spark, folder):
    return rounded(compare.comparison_table(_rule_scores(spark, folder), "f1", metrics.CLASSIFICATION))


_QUOTED = {k: v.replace("'", "''") for k, v in (("f1", compare.LOW_F1), ("gap", compare.GAP), ("r2", compare.LOW_R2),
                                               ("mape", compare.HIGH_MAPE))}


@query(
    _both_rules(
        f"""SELECT model, u.text AS recommendation FROM ranked, LATERAL (VALUES
  (m.f1 < 0.6, '{_QUOTED["f1"]}'),
  (m."precision" > 0 AND m.recall > 0 AND abs(m."precision" - m.recall) > 0.15, '{_QUOTED["gap"]}')) AS u(holds, text)
WHERE u.holds"""
    )
)
def recommendations_for_classes(spark, folder):
    return compare.recommendations(_rule_scores(spark, folder), "classification")


@query(
    f"""WITH {ESTIMATED_PRICES}, m AS (
  SELECT 'by_quantity' AS model, * FROM ({_regression_sql("by_quantity")})
  UNION ALL SELECT 'flat', * FROM ({_regression_sql("flat")}))
SELECT model, u.text AS recommendation FROM m, LATERAL (VALUES
  (r2 < 0.5, '{_QUOTED["r2"]}'), (mape > 0.3, '{_QUOTED["mape"]}')) AS u(holds, text) WHERE u.holds"""
)
def recommendations_for_numbers(spark, folder):
    cells = [F.struct(F.lit(c).alias("model"), F.col(c).alias("prediction")) for c in ("by_quantity", "flat")]
    stacked = estimated_prices(spark, folder).select("label", F.inline(F.array(*cells)))
    return compare.recommendations(metrics.regression(stacked, "label", "prediction", ["model"]), "regression")


def _rule_folds(spark, folder):
    """Accuracy of both rules in each of five folds."""
    judged = judged_documents(spark, folder)
    folded = k_folds(judged, "quality", 5, stratify=False, keys=["doc_id"])
    cells = [
        F.struct(F.lit(m).alias("model"), F.col(c).alias("prediction"))
        for m, c in (("long", "long_rule"), ("short", "short_rule"))
    ]
    stacked = folded.select("quality", "fold", F.inline(F.array(*cells)))
    return metrics.classification_wide(stacked, "quality", "prediction", ["model", "fold"]).select(
        "model", "fold", F.col("accuracy").alias("score")
    )


_FOLD_SCORES = f"""WITH {JUDGED_DOCUMENTS},
placed AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || doc_id)) - 1 AS p, count(*) OVER () AS n FROM judged),
folded AS (SELECT *, CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1)
                     ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM placed),
scores AS (SELECT 'long' AS model, fold, avg((quality = long_rule)::INTEGER) AS score FROM folded GROUP BY fold
           UNION ALL SELECT 'short', fold, avg((quality = short_rule)::INTEGER) FROM folded GROUP BY fold),
ranked AS (SELECT model, avg(score) AS score, row_number() OVER (ORDER BY avg(score) DESC, model) AS rank
           FROM scores GROUP BY model)
"""


def _fold_ranking(folds):
    means = folds.groupBy("model").agg(F.avg("score").alias("value"))
    long = means.select("model", F.lit("accuracy").alias("metric"), "value", (F.col("model") == "short").cast("int").alias("position"))
    return compare.rank_models(long, "accuracy")


@query(
    _FOLD_SCORES
    + "SELECT model, round(avg(score), 6) AS cv_mean, round(stddev_pop(score), 6) AS cv_std FROM scores GROUP BY model"
)
def fold_summary(spark, folder):
    return rounded(metrics.fold_summary(_rule_folds(spark, folder)))


@query(
    _FOLD_SCORES
    + """, d AS (SELECT max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS d
        FROM (SELECT s.model, s.fold, s.score, r.rank FROM scores s JOIN ranked r USING (model)) GROUP BY fold),
t AS (SELECT count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d),
p AS (SELECT n, t, atan(abs(t) / 2) AS a FROM t)
SELECT 'paired_t_test' AS test, (SELECT model FROM ranked WHERE rank = 1) AS model_a,
       (SELECT model FROM ranked WHERE rank = 2) AS model_b, n AS n_folds, round(t, 6) AS t_statistic,
       round(1 - sin(a) * (1 + cos(a) ** 2 / 2), 6) AS p_value, 1 - sin(a) * (1 + cos(a) ** 2 / 2) < 0.05 AS significant
FROM p"""
)
def paired_t_test(spark, folder):
    folds = _rule_folds(spark, folder)
    return rounded(compare.paired_t_test(folds, _fold_ranking(folds)))


@query(
    _both_rules(
        """SELECT a.m.f1 - b.m.f1 >= 0.01 AS should_promote, round(a.m.f1 - b.m.f1, 6) + 0.0 AS improvement,
       round(b.m.f1, 6) AS current_score, round(a.m.f1, 6) AS new_score
FROM rules a, rules b WHERE a.model = 'short' AND b.model = 'long'"""
    )
)
def promotion_by_f1(spark, folder):
    decision = compare.promotion_decision(judged_documents(spark, folder), "quality", "short_rule", "long_rule")
    return rounded(decision.drop("reason"))


@query(
    f"""WITH {ESTIMATED_PRICES}, m AS (
  SELECT avg((label - flat) ** 2) AS new_score, avg((label - by_quantity) ** 2) AS current_score FROM estimated)
SELECT current_score - new_score >= 0.01 AS should_promote, round(current_score - new_score, 2) AS improvement,
       round(current_score, 2) AS current_score, round(new_score, 2) AS new_score FROM m"""
)
def promotion_by_error(spark, folder):
    decision = compare.promotion_decision(
        estimated_prices(spark, folder), "label", "flat", "by_quantity", task="regression"
    )
    return rounded(decision.drop("reason"), 2)


# ---------------------------------------------------------------- model tables

_STAGES = "CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging' END"
_VERSIONS = f"""versions AS (
  SELECT 'model-' || o_custkey AS name, o_orderkey AS version, {_STAGES} AS stage, 'run-' || o_orderkey AS run_id FROM orders)"""


def _versions(spark, folder):
    """A version table with one version per order and one model per customer."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("model-"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "Production").when(F.col("o_orderstatus") == "O", "Staging").alias("stage"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
    )


@query(
    f"""WITH {_VERSIONS}
SELECT name, coalesce(stage, 'None') AS stage, max(version) AS version, arg_max(run_id, version) AS run_id
FROM versions GROUP BY ALL"""
)
def latest_model_versions(spark, folder):
    return latest_versions(_versions(spark, folder))


@query(f"WITH {_VERSIONS} SELECT DISTINCT name FROM versions ORDER BY name")
def registered_models(spark, folder):
    return model_names(_versions(spark, folder))


@query(
    f"""WITH {_VERSIONS}
SELECT name, version, run_id, CASE WHEN name = 'model-7' AND version = (SELECT max(version) FROM versions WHERE name = 'model-7')
         THEN 'Production' WHEN name = 'model-7' AND stage = 'Production' THEN 'Archived' ELSE stage END AS stage
FROM versions"""
)
def stage_change(spark, folder):
    versions = _versions(spark, folder)
    newest = versions.where("name = 'model-7'").agg(F.max("version")).first()[0]
    return move_stage(versions, "model-7", newest or 0, "Production", archive_existing=True)


@query(
    f"""WITH {_VERSIONS}, decided AS (SELECT 'model-' || c_custkey AS name, c_acctbal > 5000 AS win FROM customer),
facts AS (SELECT name, max(version) AS newest, arg_max(coalesce(stage, 'None'), version) AS held,
                 count(*) FILTER (stage = 'Production') AS holders FROM versions GROUP BY name)
SELECT v.name AS name, version, run_id,
  CASE WHEN win IS NULL THEN stage
       WHEN version = newest THEN CASE WHEN holders - (held = 'Production')::INTEGER = 0 OR win THEN 'Production' ELSE 'Staging' END
       WHEN stage = 'Production' AND (holders - (held = 'Production')::INTEGER = 0 OR win) THEN 'Archived'
       ELSE stage END AS stage
FROM versions v JOIN facts f ON v.name = f.name LEFT JOIN decided d ON v.name = d.name"""
)
def champion_changes(spark, folder):
    decisions = table(spark, folder, "customer").select(
        F.concat(F.lit("model-"), F.col("c_custkey").cast("string")).alias("name"),
        (F.col("c_acctbal") > 5000).alias("should_promote"),
    )
    return promote_newest(_versions(spark, folder), decisions)


@query(
    """WITH runs AS (SELECT event_id::VARCHAR AS run_id, event_type AS name,
       CASE WHEN value < 50 THEN 'failed' ELSE 'completed' END AS status, ts FROM events)
SELECT name, status, count(*) AS n_runs, epoch_us(max(ts)) AS last_started_at, arg_max(run_id, ts) AS last_run_id
FROM runs GROUP BY name, status"""
)
def run_log_summary(spark, folder):
    runs = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("event_type").alias("name"),
        F.when(F.col("value") < 50, "failed").otherwise("completed").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
    )
    return run_summary(runs).withColumn("last_started_at", F.unix_micros("last_started_at"))
