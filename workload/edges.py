"""Awkward tables, extension points, and a search whose every number SQL knows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions import metrics, stats
from tablelearn.functions.ordering import order_hash
from tablelearn.operators import compare, models
from tablelearn.operators.features import DatetimeParts, FeatureChain, JsonStage, METHODS, OneHotVector, add_method, encoder
from tablelearn.operators.models import FEATURES, LABEL
from tablelearn.operators.profile import validate_completeness
from tablelearn.operators.splits import TRAIN, VAL, k_folds, random_split, split_shapes, time_split
from tablelearn.plans.job import run_job
from tablelearn.plans.registry import Registry, RunLog
from tablelearn.plans.search import (
    CLASS_SCORES,
    REGRESSION_SCORES,
    Trainer,
    plan_scores,
    results_table,
    scorer,
    validation_metrics,
)
from tablelearn.plans.spec import EvaluationSpec, FeatureSpec, JobSpec, TrainingSpec
from tablelearn.session import scratch_path, store
from tablelearn.sources.readers import read_json_payload
from tablelearn.streaming.scoring import score
from workload import query
from workload.evaluation import class_metrics_sql
from workload.inputs import (
    DOCUMENT_FEATURES,
    ESTIMATED_PRICES,
    JUDGED_DOCUMENTS,
    documents_measured,
    estimated_prices,
    judged_documents,
    rounded,
    table,
)
from workload.training import _LINE, _fit

# ---------------------------------------------------------------- rows that repeat, keys and times that collide


@query(
    """WITH s AS (SELECT count(*) AS n, ceil(0.2::DOUBLE * count(*)) AS t FROM lineitem),
parts AS (SELECT n, t, ceil((0.1::DOUBLE / (1 - 0.2::DOUBLE)) * (n - t)) AS v FROM s)
SELECT u.part AS split, u.size::BIGINT AS n_rows, 2::BIGINT AS n_columns
FROM parts, LATERAL (VALUES ('test', t), ('val', v), ('train', n - t - v)) AS u(part, size)"""
)
def split_of_repeated_rows(spark, folder):
    """Two columns of the line items: a few dozen different rows, each very often."""
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linenumber")
    return split_shapes(random_split(df, "l_linenumber", stratify=False))


@query(
    """WITH s AS (SELECT l_returnflag, count(*) AS n, sum(count(*)) OVER (ORDER BY l_returnflag) - count(*) AS b FROM lineitem
           GROUP BY 1)
SELECT i::INTEGER AS fold, l_returnflag, (floor((b + n + 4 - i) / 5) - floor((b + 4 - i) / 5))::BIGINT AS n
FROM s, range(5) AS f(i)"""
)
def folds_of_repeated_rows(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linenumber")
    return k_folds(df, "l_returnflag", 5).groupBy("fold", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN r <= floor(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train'
                      WHEN r <= floor(n * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def split_by_large_whole_times(spark, folder):
    """Times in nanoseconds, which no double can tell apart."""
    at = F.lit(1_700_000_000_000_000_000) + F.col("event_id")
    df = table(spark, folder, "events").select("event_id", at.cast("long").alias("at"))
    return time_split(df, "at", keys=["event_id"]).select("event_id", "split")


@query(
    """SELECT count(DISTINCT (a, b)) AS n_keys, count(DISTINCT (a, b)) AS n_hashes FROM (
  SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS a,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-' || o_orderstatus END AS b FROM orders)"""
)
def hashes_of_awkward_keys(spark, folder):
    """Keys with the separator in them, empty and missing parts: as many hashes as keys."""
    orders = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("a"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("-"), "o_orderstatus")).alias("b"),
    )
    keys = orders.groupBy("a", "b").agg(F.min(order_hash(orders, ["a", "b"], 1)).alias("h"))
    return keys.agg(F.count(F.lit(1)).alias("n_keys"), F.count_distinct("h").alias("n_hashes"))


# ---------------------------------------------------------------- correlations with gaps

_WIDTHS = (3, 4, 5, 64)


def _gappy(k: int) -> tuple[str, str]:
    """Column k: missing in every (7 + k)-th part, as NULL where k is even, else as NaN."""
    value = f"p_size * {k % 5 + 1} + p_retailprice * {k % 7} - p_partkey % {k + 11} * {50 * (k % 3)}"
    gap = "NULL" if k % 2 == 0 else "double('NaN')"
    shown = f"CASE WHEN p_partkey % {7 + k} = 0 THEN {gap} ELSE double({value}) END AS c{k}"
    return shown, f"CASE WHEN p_partkey % {7 + k} <> 0 THEN ({value})::DOUBLE END"


def _gaps_sql() -> str:
    values = ", ".join(_gappy(k)[1] for k in range(max(_WIDTHS)))
    widths = ", ".join(f"({w})" for w in _WIDTHS)
    return f"""WITH g AS (SELECT [{values}] AS v FROM part),
cells AS (SELECT a.i, b.j, v[a.i + 1] AS x, v[b.j + 1] AS y FROM g, range(0, 64) AS a(i), range(0, 64) AS b(j) WHERE a.i < b.j),
r AS (SELECT i, j, round(corr(x, y), 6) + 0.0 AS r FROM cells WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY i, j)
SELECT w.width AS width, i::INTEGER AS i, j::INTEGER AS j, r FROM r, (VALUES {widths}) AS w(width) WHERE j < w.width"""


@query(_gaps_sql())
def correlations_with_gaps(spark, folder):
    """The same answer for a pair whatever the number of columns beside it."""
    df = table(spark, folder, "part").selectExpr(*[_gappy(k)[0] for k in range(max(_WIDTHS))])
    parts = [
        stats.correlations(df, df.columns[:w]).select(F.lit(w).alias("width"), "i", "j", "r") for w in _WIDTHS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@query("""SELECT 'a' AS "left", 'b' AS "right", NULL::DOUBLE AS r""")
def correlation_of_a_constant_part(spark, folder):
    """One column is constant wherever the other is present, though not as a whole."""
    even = F.col("l_orderkey") % 2 == 0
    df = table(spark, folder, "lineitem").select(
        F.when(even, F.lit(0.1)).otherwise(F.col("l_extendedprice")).alias("a"),
        F.when(even, F.col("l_quantity").cast("double")).alias("b"),
    )
    return stats.correlations(df, ["a", "b"]).select("left", "right", "r")


# ---------------------------------------------------------------- checks, features and readers


@query("""SELECT 'completeness' AS "check", NULL::VARCHAR AS "column", 'error' AS severity""")
def empty_table_check(spark, folder):
    rows = table(spark, folder, "lineitem").where("l_quantity < 0")
    return validate_completeness(rows).select("check", "column", "severity")


@query(
    """SELECT event_id, hour(ts) AS ts_hour, day(ts) AS ts_day, month(ts) AS ts_month, isodow(ts) - 1 AS ts_dayofweek,
       (isodow(ts) > 5)::BIGINT AS ts_is_weekend FROM events"""
)
def datetime_features_of_text(spark, folder):
    df = table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return DatetimeParts("ts").transform(df)


@query(
    """SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice) OVER (PARTITION BY l_shipdate), 4) + 0.0 AS mean_of_day,
       dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code FROM lineitem"""
)
def encoders_by_name(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("string").alias("mean_of_day"),
        F.col("l_returnflag").alias("code"),
        "l_extendedprice",
    )
    df = encoder("target", "l_extendedprice", ["mean_of_day"]).fit(df).transform(df)
    df = encoder("label", columns=["code"]).fit(df).transform(df)
    return rounded(df.drop("l_extendedprice"), 4)


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, dense_rank() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS place,
                  dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS urgency FROM orders),
n AS (SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders)
SELECT o_orderkey, (customers + priorities)::BIGINT AS size, urgency || ',' || (priorities + place) AS ones FROM c, n"""
)
def one_hot_vector(spark, folder):
    """One place in a sparse vector for every customer and every priority."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").cast("string").alias("c"))
    model = OneHotVector(["o_orderpriority", "c"], out="flags").fit(df)
    text = F.from_json(F.to_json(F.struct("flags")), "flags struct<size: bigint, indices: array<bigint>>")
    return model.transform(df).select("o_orderkey", text["flags"]["size"].alias("size"), F.array_join(text["flags"]["indices"], ",").alias("ones"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 2 AS l_quantity FROM lineitem")
def custom_feature_step(spark, folder):
    class Halved(JsonStage):
        def _transform(self, df: DataFrame) -> DataFrame:
            return df.withColumn(self.known["column"], F.col(self.known["column"]) / 2)

    add_method("halve", lambda target=None, exclude=(), **p: Halved(**p))
    try:
        df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double"))
        return FeatureChain().add_step("half", "halve", column="l_quantity").fit_transform(df)
    finally:
        METHODS.pop("halve")


# Orders of one landed response, which bounds its file.
_PAGE = 10_000


def _landed(spark, folder: str, shape: Column) -> str:
    """A folder with one response per page of orders, each a file of its own that holds ``shape`` as JSON."""
    path = scratch_path(spark, "payload")
    orders = table(spark, folder, "orders").withColumn("page", F.floor(F.col("o_orderkey") / _PAGE))
    pages = orders.groupBy("page").agg(F.to_json(shape).alias("value"))
    pages.write.partitionBy("page").text(path)
    return path


def _orders() -> Column:
    return F.collect_list(F.struct("o_orderkey", "o_orderpriority", F.array(F.struct("o_custkey")).alias("data")))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderpriority, 1 AS n_data FROM orders")
def json_list_with_data(spark, folder):
    """A list keeps its columns, also one that is called data."""
    landed = read_json_payload(spark, _landed(spark, folder, _orders()))
    return landed.select("o_orderkey", "o_orderpriority", F.size("data").alias("n_data"))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderpriority FROM orders")
def json_data_object(spark, folder):
    """Objects whose rows are under data."""
    landed = read_json_payload(spark, _landed(spark, folder, F.struct(_orders().alias("data"))))
    return landed.select("o_orderkey", "o_orderpriority")


@query(
    "SELECT count(*) AS n, sum(o_orderkey)::DOUBLE AS total FROM orders "
    f"GROUP BY o_orderkey::BIGINT // {_PAGE}"
)
def json_single_object(spark, folder):
    """Objects that are one row each."""
    shape = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("double")).alias("total"))
    return read_json_payload(spark, _landed(spark, folder, shape)).select("n", "total")


# ---------------------------------------------------------------- metrics and advice


@query(
    f"""WITH {ESTIMATED_PRICES}, e AS (SELECT max(abs(label - by_quantity)) AS a, max(abs(label - flat)) AS b FROM estimated)
SELECT u.model AS model, round(u.v, 6) AS score, rank() OVER (ORDER BY u.v)::INTEGER AS rank
FROM e, LATERAL (VALUES ('by_quantity', a), ('flat', b)) AS u(model, v)"""
)
def custom_error_metric(spark, folder):
    """An added metric that is better when lower, through the dispatcher and into the ranking."""
    df = estimated_prices(spark, folder)
    metrics.add_metric("largest_error", lambda y, p: F.max(F.abs(y - p)), lower_is_better=True)
    try:
        parts = [
            metrics.evaluate(df, "regression", "label", name).select(
                F.lit(name).alias("model"), F.lit(i).alias("position"), "metric", "value"
            )
            for i, name in enumerate(("by_quantity", "flat"))
        ]
        return rounded(compare.rank_models(parts[0].unionByName(parts[1]), "largest_error").select("model", "score", "rank"))
    finally:
        metrics.CUSTOM.pop("largest_error")
        metrics.LOWER_IS_BETTER.discard("largest_error")


_QUOTED = {k: v.replace("'", "''") for k, v in (("f1", compare.LOW_F1), ("gap", compare.GAP))}


@query(
    f"""WITH {JUDGED_DOCUMENTS}, wrong AS (SELECT quality, 1 - long_rule AS rule FROM judged),
{class_metrics_sql("wrong", "quality", "rule")}
SELECT 'wrong' AS model, u.text AS recommendation FROM m, LATERAL (VALUES
  (m.f1 < 0.6, '{_QUOTED["f1"]}'),
  (m."precision" > 0 AND m.recall > 0 AND abs(m."precision" - m.recall) > 0.15, '{_QUOTED["gap"]}')) AS u(holds, text)
WHERE u.holds"""
)
def recommendations_for_a_poor_model(spark, folder):
    """A rule that says the opposite of what it should."""
    df = judged_documents(spark, folder).withColumn("rule", 1 - F.col("long_rule"))
    scores = metrics.evaluate(df, "classification", "quality", "rule").withColumn("model", F.lit("wrong"))
    return compare.recommendations(scores, "classification")


@query(
    f"""WITH {ESTIMATED_PRICES}, r AS (
  SELECT 1 - avg((label - by_quantity) ** 2) / var_pop(label) AS r2 FROM estimated)
SELECT format('Best model: by_quantity (r2={{:.4f}}, CV mean={{:.4f}} +/- {{:.4f}})', r2, r2, 0.0::DOUBLE) AS said FROM r"""
)
def winner_sentence(spark, folder):
    row = metrics.regression_wide(estimated_prices(spark, folder), "label", "by_quantity").first()
    said = compare.summary_text("by_quantity", "r2", row["r2"], row["r2"], 0.0, None)
    return spark.createDataFrame([(said,)], "said string")


# ---------------------------------------------------------------- registry, run log, whole jobs


@query(
    _LINE
    + """, flat AS (SELECT avg(value) AS m FROM events)
SELECT 'champion' AS model, event_id, round(m, 6) AS prediction FROM events, flat
UNION ALL SELECT 'version 1', event_id, prediction FROM scored"""
)
def models_by_version(spark, folder):
    """Two registered versions: the first is asked for by number, the second is the champion."""
    events = table(spark, folder, "events").select("event_id", "user_id", "value", F.lit(1.0).alias("one"))
    registry = Registry(spark, scratch_path(spark, "registry"))
    for column in ("user_id", "one"):
        fitted, _ = _fit(events, "linear_regression", {}, "value", [column], "regression")
        registry.register(fitted, "events", {}, {}, [column])
    registry.set_stage("events", 2, archive_existing=True)
    both = {"version 1": registry.load_version("events", 1), "champion": registry.load_production("events")}
    parts = [score(m, events, ["event_id"]).select(F.lit(k).alias("model"), "event_id", "prediction") for k, m in both.items()]
    return rounded(parts[0].unionByName(parts[1]))


@query(
    """SELECT u.name AS name, u.status AS status, u.n AS n_metrics
FROM (VALUES ('lengths/linear_regression', 'trained', 4), ('lengths', 'completed', 5)) AS u(name, status, n)"""
)
def job_run_log(spark, folder):
    """What a job notes of its candidates and of itself; the job has its own table, split and settings."""
    source = documents_measured(spark, folder).select("doc_id", "n_chars", *DOCUMENT_FEATURES[1:3])
    spec = JobSpec(
        "lengths",
        "documents",
        "n_chars",
        FeatureSpec(missing_strategy="mean", categorical_strategy="label"),
        TrainingSpec("regression", ["linear_regression"], n_trials=1, cv_folds=2, metric="r2"),
        EvaluationSpec("r2", cv_folds=2),
        key_columns=["doc_id"],
    )
    path = scratch_path(spark, "registry")
    before = datetime.now(timezone.utc)
    run_job(spark, spec, path, source=source)
    runs = RunLog(spark, path).history().where(F.col("started_at") >= F.lit(before) - F.expr("interval 1 minute"))
    return runs.select("name", "status", F.size("metrics").alias("n_metrics"))


# ---------------------------------------------------------------- a search with an exact answer


class ScaledMean(Estimator):
    """Predicts a multiple of the mean label."""

    def __init__(self, factor: float):
        super().__init__()
        self.factor = factor

    def _fit(self, df: DataFrame) -> ScaledMeanModel:
        return ScaledMeanModel(value=self.factor * df.agg(F.avg(LABEL)).first()[0])


class ScaledMeanModel(JsonStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        # Reads the features, as every model does.
        return df.withColumn("prediction", F.when(F.col(FEATURES).isNotNull(), F.lit(float(self.known["value"]))))


_FACTORS = [0.5, 0.9, 1.5]


@query(
    """WITH d AS (SELECT doc_id, n_chars::DOUBLE AS y, len(string_split(text, ' '))::DOUBLE AS x FROM documents),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || doc_id)) AS r, count(*) OVER () AS n FROM d),
sizes AS (SELECT *, ceil(0.2::DOUBLE * n) AS t FROM ranked),
parts AS (SELECT *, t + ceil((0.1::DOUBLE / (1 - 0.2::DOUBLE)) * (n - t)) AS held FROM sizes),
train AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || doc_id)) - 1 AS p, count(*) OVER () AS m FROM parts WHERE r > held),
folded AS (SELECT *, CASE WHEN p < (m % 5) * (m // 5 + 1) THEN p // (m // 5 + 1)
                     ELSE m % 5 + (p - (m % 5) * (m // 5 + 1)) // (m // 5) END AS fold FROM train),
folds AS (SELECT f AS fold, avg(y) AS rest FROM folded JOIN range(5) AS k(f) ON fold <> f GROUP BY f),
scored AS (SELECT factor, fold, 1 - avg((y - factor * rest) ** 2) / var_pop(y) AS r2
           FROM folded JOIN folds USING (fold), (VALUES (0.5::DOUBLE), (0.9), (1.5)) AS c(factor) GROUP BY factor, fold),
chosen AS (SELECT factor FROM scored GROUP BY factor ORDER BY avg(r2) DESC, factor LIMIT 1),
fits AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, avg(y) * max(factor) AS c FROM train, chosen),
val AS (SELECT y, a * x + b AS p, c AS q FROM parts, fits WHERE r > t AND r <= held),
m AS (SELECT 'linear_regression' AS model, avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse, 1 - avg((y - p) ** 2) / var_pop(y) AS r2
      FROM val UNION ALL SELECT 'scaled_mean', avg(abs(y - q)), avg((y - q) ** 2), 1 - avg((y - q) ** 2) / var_pop(y) FROM val),
placed AS (SELECT *, rank() OVER (ORDER BY r2 DESC) AS place FROM m)
SELECT place::INTEGER AS position, model, u.metric AS metric, round(u.v, 4) + 0.0 AS value
FROM placed, LATERAL (VALUES ('mae', mae), ('mse', mse), ('rmse', sqrt(mse)), ('r2', r2)) AS u(metric, v)"""
)
def search_with_known_scores(spark, folder):
    """Five folds and three trials of an added family beside a plain fit: choice, refit and ranking."""
    df = store(documents_measured(spark, folder).select("doc_id", "n_chars", "words"))
    split = random_split(df, "n_chars", keys=["doc_id"], stratify=False)
    models.add_family("regression", "scaled_mean", lambda params, shape: ScaledMean(**params), {"factor": _FACTORS})
    try:
        trainer = Trainer("regression", ["scaled_mean", "linear_regression"], n_trials=3, cv_folds=5)
        result = trainer.train(
            split.where(F.col("split") == TRAIN), split.where(F.col("split") == VAL), "n_chars", ["words"], ["doc_id"]
        )
    finally:
        models.FAMILIES["regression"].pop("scaled_mean")
        models.SPACES["regression"].pop("scaled_mean")
    return rounded(results_table(result, split).drop("training_time"), 4)


_ERRORS = """(SELECT avg(abs(label - by_quantity)) AS mae, avg((label - by_quantity) ** 2) AS mse,
  sqrt(avg((label - by_quantity) ** 2)) AS rmse, 1 - avg((label - by_quantity) ** 2) / var_pop(label) AS r2 FROM estimated)"""


@query(
    f"""WITH {JUDGED_DOCUMENTS}, {ESTIMATED_PRICES}, {class_metrics_sql("judged", "quality", "long_rule")},
named AS (
  SELECT k.kind, u.task, u.metric, u.v
  FROM (VALUES ('search'), ('trees')) AS k(kind), m, {_ERRORS} AS e, LATERAL (VALUES
    ('classification', 'accuracy', m.accuracy), ('classification', 'precision', m."precision"),
    ('classification', 'recall', m.recall), ('classification', 'f1', m.f1),
    ('regression', 'mae', e.mae), ('regression', 'mse', e.mse), ('regression', 'rmse', e.rmse),
    ('regression', 'r2', e.r2)) AS u(task, metric, v))
SELECT kind, task, metric, round(v, CASE WHEN task = 'regression' AND metric <> 'r2' THEN 1 ELSE 6 END) + 0.0 AS value
FROM (FROM named UNION ALL SELECT 'validation', task, metric, v FROM named
      WHERE kind = 'search' AND metric NOT IN ('precision', 'recall'))"""
)
def scores_by_name(spark, folder):
    """Every scoring name of the searches, in both ways of searching, and the metrics of validation rows."""
    judged = judged_documents(spark, folder).select(
        "quality", F.col("quality").cast("double").alias(LABEL), F.col("long_rule").cast("double").alias("prediction")
    )
    prices = estimated_prices(spark, folder).select("label", F.col("label").alias(LABEL), F.col("by_quantity").alias("prediction"))
    rows = []
    for task, df, target, names in (
        ("classification", store(judged), "quality", CLASS_SCORES),
        ("regression", store(prices), "label", REGRESSION_SCORES),
    ):
        found = df.select(F.lit(0).alias("fit"), F.col(LABEL).alias("label"), "prediction")
        rows += [("search", task, n, scorer(task, n).evaluate(df)) for n in names]
        rows += [("trees", task, n, plan_scores(found, task, n)[0]) for n in names]
        rows += [("validation", task, n, v) for n, v in validation_metrics(df, target, task).items()]
    scores = spark.createDataFrame(rows, "kind string, task string, metric string, value double")
    large = (F.col("task") == "regression") & (F.col("metric") != "r2")
    return scores.withColumn("value", F.when(large, F.round("value", 1)).otherwise(F.round("value", 6)) + 0.0)
