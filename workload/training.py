"""Model fits, search, scoring in batch and stream, and the whole job."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tablelearn.functions import metrics
from tablelearn.operators.features import FillMissing, Scale
from tablelearn.operators.labels import class_list
from tablelearn.operators.models import Shape, estimator
from tablelearn.operators.splits import TEST, TRAIN, VAL, random_split
from tablelearn.plans.job import run_job
from tablelearn.plans.search import (
    Candidate,
    Trainer,
    assemble,
    finished,
    fold_scores,
    predict,
    results_table,
)
from tablelearn.plans.spec import EvaluationSpec, FeatureSpec, JobSpec, TrainingSpec
from tablelearn.session import scratch_path, store
from tablelearn.streaming.scoring import (
    prediction_counts,
    read_stream,
    score,
    stream_issues,
    validate_stream,
    write_scores,
)
from workload import query
from workload.inputs import DOCUMENT_FEATURES, documents_measured, labelled_documents, rounded, table

# The shipped searches: these families, their whole spaces, 10 trials and 5 folds.
CLASSIFIERS = ["logistic_regression", "random_forest", "xgboost", "lightgbm"]
REGRESSORS = ["linear_regression", "random_forest", "xgboost", "lightgbm"]


def _split_documents(spark, folder):
    """Labelled documents, filled and scaled, with a stratified split.

    The texts are measured once and the small result stored for all later scans.
    """
    df = store(labelled_documents(spark, folder).select("doc_id", "quality", *DOCUMENT_FEATURES))
    for stage in (FillMissing("median", DOCUMENT_FEATURES), Scale("standard", DOCUMENT_FEATURES)):
        df = stage.fit(df).transform(df)
    return random_split(df, "quality", keys=["doc_id"])


def _fit(df, name, params, target, columns, task):
    classes = class_list(df, target) if task == "classification" else None
    ready = assemble(df, columns, target, task, classes)
    fitted = estimator(task, name, params, Shape(task, df.count(), len(classes or ()))).fit(ready)
    return finished(fitted, columns, classes, df.schema[target].dataType.simpleString()), classes


def _classified(spark, folder, name, params):
    split = _split_documents(spark, folder)
    model, classes = _fit(split.where(F.col("split") != TEST), name, params, "quality", DOCUMENT_FEATURES, "classification")
    scored = predict(model, split.where(F.col("split") == TEST))
    return rounded(metrics.classification(scored, "quality", "prediction", "probabilities", classes))


@query()
def train_logistic(spark, folder):
    return _classified(spark, folder, "logistic_regression", {"C": 10.0, "max_iter": 100})


@query()
def train_forest(spark, folder):
    return _classified(spark, folder, "random_forest", {"n_estimators": 50, "max_depth": 5})


@query()
def train_boosted_by_depth(spark, folder):
    params = {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.2, "subsample": 0.8, "colsample_bytree": 0.8}
    return _classified(spark, folder, "xgboost", params)


@query()
def train_boosted_by_leaves(spark, folder):
    return _classified(spark, folder, "lightgbm", {"n_estimators": 50, "num_leaves": 8, "learning_rate": 0.2})


@query()
def train_boosted_many_classes(spark, folder):
    """Language from document statistics by one boosted model per class."""
    df = store(documents_measured(spark, folder).select("doc_id", "lang", *DOCUMENT_FEATURES))
    split = random_split(df, "lang", keys=["doc_id"])
    params = {"n_estimators": 50, "max_depth": 3}
    model, classes = _fit(split.where(F.col("split") != TEST), "xgboost", params, "lang", DOCUMENT_FEATURES, "classification")
    scored = predict(model, split.where(F.col("split") == TEST))
    return rounded(metrics.classification(scored, "lang", "prediction", "probabilities", classes))


@query()
def search_classifiers(spark, folder):
    split = _split_documents(spark, folder)
    trainer = Trainer("classification", CLASSIFIERS, n_trials=10, cv_folds=5)
    result = trainer.train(
        split.where(F.col("split") == TRAIN), split.where(F.col("split") == VAL), "quality", DOCUMENT_FEATURES, ["doc_id"]
    )
    return rounded(results_table(result, split).drop("training_time"))


@query()
def search_regressors(spark, folder):
    columns = ["words", "distinct_words", "non_letters"]
    df = store(documents_measured(spark, folder).select("doc_id", "n_chars", *columns))
    split = random_split(df, "n_chars", keys=["doc_id"])
    trainer = Trainer("regression", REGRESSORS, n_trials=10, cv_folds=5)
    result = trainer.train(
        split.where(F.col("split") == TRAIN), split.where(F.col("split") == VAL), "n_chars", columns, ["doc_id"]
    )
    return rounded(results_table(result, split).drop("training_time"))


# ---------------------------------------------------------------- fits with an exact answer in SQL


def _flagged(spark, folder):
    """Orders with one yes/no feature: models of it can only learn group frequencies and means."""
    return table(spark, folder, "orders").select(
        (F.col("o_totalprice") > 250000).cast("double").alias("dear"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
        F.col("o_custkey").cast("double").alias("customer"),
    )


_FLAGGED = """flagged AS (SELECT (o_totalprice > 250000)::INTEGER::DOUBLE AS dear, o_orderstatus AS status,
  (o_orderstatus = 'F')::INTEGER AS done, o_custkey::DOUBLE AS customer FROM orders)"""


def _per_flag(model, df, extra):
    return rounded(predict(model, df).groupBy("dear").agg(extra.alias("value")), 5)


_ALL_ROWS = {"n_estimators": 3, "max_depth": 2, "bootstrap": False}
_DONE_SHARE = f"WITH {_FLAGGED} SELECT dear, round(avg(done), 5) AS value FROM flagged GROUP BY dear"


@query(_DONE_SHARE)
def logistic_on_a_flag(spark, folder):
    """Almost unpenalised, so the probability is the group's share."""
    df = _flagged(spark, folder)
    params = {"C": 1e9, "tol": 1e-14}
    model, _ = _fit(df, "logistic_regression", params, "done", ["dear"], "classification")
    return _per_flag(model, df, F.max(F.element_at("probabilities", 2)))


@query(
    f"""WITH {_FLAGGED}, sizes AS (SELECT dear, count(*) AS n FROM flagged GROUP BY dear)
SELECT dear, status, round(count(*) / any_value(n), 4) AS share FROM flagged JOIN sizes USING (dear) GROUP BY dear, status"""
)
def logistic_with_three_classes(spark, folder):
    df = _flagged(spark, folder)
    params = {"C": 1e9, "tol": 1e-14}
    model, classes = _fit(df, "logistic_regression", params, "status", ["dear"], "classification")
    names = F.array(*[F.lit(c) for c in classes])
    shares = predict(model, df).groupBy("dear").agg(F.max_by("probabilities", F.lit(1)).alias("p"))
    return rounded(shares.select("dear", F.inline(F.arrays_zip(names.alias("status"), F.col("p").alias("share")))), 4)


@query(
    """SELECT (o_totalprice > 250000)::INTEGER::DOUBLE AS dear, round(avg((o_totalprice > 200000)::INTEGER), 5) AS value
FROM orders GROUP BY 1"""
)
def forest_on_a_flag(spark, folder):
    """Without resampling every tree sees all rows, so a leaf holds its group's share.

    The groups differ in their majority: leaves that agree in it would be merged.
    """
    price = F.col("o_totalprice")
    df = table(spark, folder, "orders").select(
        (price > 250000).cast("double").alias("dear"), (price > 200000).cast("int").alias("pricey")
    )
    model, _ = _fit(df, "random_forest", _ALL_ROWS, "pricey", ["dear"], "classification")
    return _per_flag(model, df, F.max(F.element_at("probabilities", 2)))


_CUSTOMER_MEAN = f"WITH {_FLAGGED} SELECT dear, round(avg(customer), 5) AS value FROM flagged GROUP BY dear"


@query(_CUSTOMER_MEAN)
def regression_forest_on_a_flag(spark, folder):
    df = _flagged(spark, folder)
    model, _ = _fit(df, "random_forest", _ALL_ROWS, "customer", ["dear"], "regression")
    return _per_flag(model, df, F.max("prediction"))


@query(_CUSTOMER_MEAN)
def boosting_on_a_flag(spark, folder):
    df = _flagged(spark, folder)
    model, _ = _fit(df, "xgboost", {"n_estimators": 1, "max_depth": 2}, "customer", ["dear"], "regression")
    return _per_flag(model, df, F.max("prediction"))


@query(_CUSTOMER_MEAN)
def leaf_boosting_on_a_flag(spark, folder):
    df = _flagged(spark, folder)
    model, _ = _fit(df, "lightgbm", {"n_estimators": 1, "num_leaves": 2}, "customer", ["dear"], "regression")
    return _per_flag(model, df, F.max("prediction"))



@query(
    """SELECT round(regr_slope(n_chars, words), 6) AS words, round(regr_intercept(n_chars, words), 4) AS intercept
FROM (SELECT n_chars, len(string_split(text, ' '))::DOUBLE AS words FROM documents)"""
)
def train_linear(spark, folder):
    df = documents_measured(spark, folder).select("n_chars", "words")
    model, _ = _fit(df, "linear_regression", {}, "n_chars", ["words"], "regression")
    line = model.stages[1]
    return spark.createDataFrame(
        [(round(float(line.coefficients[0]), 6), round(float(line.intercept), 4))], "words double, intercept double"
    )


@query(
    """WITH s AS (SELECT var_pop(l_quantity) AS a, var_pop(l_discount) AS b, covar_pop(l_quantity, l_discount) AS c,
                  covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q,
                  avg(l_quantity) AS x, avg(l_discount) AS z, avg(l_extendedprice) AS y FROM lineitem),
w AS (SELECT (b * p - c * q) / (a * b - c * c) AS w1, (a * q - c * p) / (a * b - c * c) AS w2, x, y, z FROM s)
SELECT round(w1, 3) AS l_quantity, round(w2, 2) AS l_discount, round(y - w1 * x - w2 * z, 2) AS intercept FROM w"""
)
def train_linear_two_columns(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    columns = ["l_quantity", "l_discount"]
    model, _ = _fit(df, "linear_regression", {}, "l_extendedprice", columns, "regression")
    line = model.stages[1]
    row = (round(float(line.coefficients[0]), 3), round(float(line.coefficients[1]), 2), round(float(line.intercept), 2))
    return spark.createDataFrame([row], "l_quantity double, l_discount double, intercept double")


_LINE = """WITH line AS (SELECT regr_slope(value, user_id) AS a, regr_intercept(value, user_id) AS b FROM events),
scored AS (SELECT event_id, ts, round(a * user_id + b, 6) AS prediction FROM events, line)
"""


def _event_model(spark, folder) -> PipelineModel:
    df = table(spark, folder, "events").select("user_id", "value")
    model, _ = _fit(df, "linear_regression", {}, "value", ["user_id"], "regression")
    path = scratch_path(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


@query(_LINE + "SELECT event_id, prediction FROM scored")
def batch_scores(spark, folder):
    """A saved and reloaded model on the whole table."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    return rounded(score(_event_model(spark, folder), events, ["event_id"]))


def _streamed(spark, folder):
    schema = table(spark, folder, "events").schema
    return read_stream(spark, f"{folder}/events.parquet", schema)


@query(_LINE + "SELECT event_id, prediction FROM scored")
def stream_scores(spark, folder):
    """The same model on the table read as a stream."""
    scored = score(_event_model(spark, folder), _streamed(spark, folder), ["event_id"])
    path = scratch_path(spark, "scores")
    write_scores(scored, path, scratch_path(spark, "state")).awaitTermination()
    return rounded(spark.read.parquet(path))


@query(
    _LINE
    + """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day, count(*) AS n, round(avg(prediction), 4) AS mean_prediction
FROM scored GROUP BY 1 HAVING epoch_us(time_bucket(INTERVAL 1 DAY, ts)) + 86400000000
  <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)"""
)
def stream_score_windows(spark, folder):
    """Scores per day; the days the watermark has not passed are still open."""
    scored = score(_event_model(spark, folder), _streamed(spark, folder), ["event_id", "ts"])
    days = prediction_counts(scored, "ts", "1 day", "1 hour")
    flat = days.select(F.unix_micros("window.start").alias("day"), "n", "mean_prediction")
    path = scratch_path(spark, "windows")
    write_scores(flat, path, scratch_path(spark, "state")).awaitTermination()
    return rounded(spark.read.parquet(path), 4)


@query(
    """SELECT 'range' AS "check", 'value' AS "column", 'error' AS severity FROM (SELECT max(value) AS m FROM events)
WHERE m > 100 UNION ALL SELECT 'schema', 'region', 'error'"""
)
def stream_validation(spark, folder):
    checks = {"expected_columns": ["event_id", "region"], "column_ranges": {"value": (0, 100)}}
    path = scratch_path(spark, "issues")
    validate_stream(_streamed(spark, folder), path, scratch_path(spark, "state"), **checks).awaitTermination()
    return stream_issues(spark, path).select("check", "column", "severity").distinct()


# ---------------------------------------------------------------- whole job


@query()
def training_job(spark, folder):
    """Documents to a registered and promoted quality model."""
    source = labelled_documents(spark, folder).select("doc_id", "lang", "quality", *DOCUMENT_FEATURES)
    spec = JobSpec(
        "documents",
        "documents",
        "quality",
        FeatureSpec(correlation_threshold=0.99),
        TrainingSpec(models=CLASSIFIERS, n_trials=10, cv_folds=5),
        EvaluationSpec(cv_folds=5),
        key_columns=["doc_id"],
    )
    result = run_job(spark, spec, scratch_path(spark, "registry"), source=source)
    rows = [(result.best_model, m, float(v), result.promotion["stage"]) for m, v in sorted(result.metrics.items())]
    return rounded(spark.createDataFrame(rows, "model string, metric string, value double, stage string"))


@query(
    """WITH d AS (SELECT doc_id, n_chars::DOUBLE AS y, len(string_split(text, ' '))::DOUBLE AS x FROM documents),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || sha256(doc_id::VARCHAR))) AS r, count(*) OVER () AS n FROM d),
sizes AS (SELECT *, ceil(0.2::DOUBLE * n) AS t FROM ranked),
parts AS (SELECT *, t + ceil((0.1::DOUBLE / (1 - 0.2::DOUBLE)) * (n - t)) AS held FROM sizes),
line AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM parts WHERE r > held),
test AS (SELECT y, a * x + b AS p FROM parts, line WHERE r <= t),
m AS (SELECT avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse, sqrt(avg((y - p) ** 2)) AS rmse,
             1 - avg((y - p) ** 2) / var_pop(y) AS r2,
             avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape FROM test)
SELECT 'linear_regression' AS model, u.metric AS metric, round(u.v, 4) AS value, 'Production' AS stage
FROM m, LATERAL (VALUES ('mae', mae), ('mse', mse), ('rmse', rmse), ('r2', r2), ('mape', mape)) AS u(metric, v)"""
)
def linear_training_job(spark, folder):
    """A whole job whose every step has exact SQL: split, fit and test metrics."""
    source = documents_measured(spark, folder).select("doc_id", "n_chars", "words")
    spec = JobSpec(
        "lengths",
        "documents",
        "n_chars",
        FeatureSpec(missing_strategy="mean", categorical_strategy="label"),
        TrainingSpec("regression", ["linear_regression"], n_trials=1, cv_folds=2, metric="r2"),
        EvaluationSpec("r2", cv_folds=2),
        key_columns=["doc_id"],
    )
    result = run_job(spark, spec, scratch_path(spark, "registry"), source=source)
    rows = [(result.best_model, m, round(float(v), 4), result.promotion["stage"]) for m, v in result.metrics.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double, stage string")


@query(
    """WITH d AS (SELECT doc_id, n_chars::DOUBLE AS y, len(string_split(text, ' '))::DOUBLE AS x FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || doc_id)) - 1 AS p, count(*) OVER () AS n FROM d),
folded AS (SELECT *, CASE WHEN p < (n % 3) * (n // 3 + 1) THEN p // (n // 3 + 1)
                     ELSE n % 3 + (p - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM placed),
lines AS (SELECT f.fold AS fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b
          FROM folded JOIN (VALUES (0), (1), (2)) AS f(fold) ON folded.fold <> f.fold GROUP BY f.fold)
SELECT fold::INTEGER AS fold, round(1 - avg((y - a * x - b) ** 2) / var_pop(y), 6) AS score
FROM folded JOIN lines USING (fold) GROUP BY fold"""
)
def refit_fold_scores(spark, folder):
    """r2 of a linear model refitted without each fold in turn."""
    df = store(documents_measured(spark, folder).select("doc_id", "n_chars", "words"))
    candidate = Candidate("linear_regression", None, {}, {}, 0.0)
    scores = fold_scores(df, "n_chars", ["words"], "regression", [candidate], 3, keys=["doc_id"])[candidate.name]
    rows = [(i, round(float(v), 6)) for i, v in enumerate(scores)]
    return spark.createDataFrame(rows, "fold int, score double")
