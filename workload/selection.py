"""Correlations, filters, splits and folds."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tablelearn.functions import stats
from tablelearn.functions.ordering import global_rank
from tablelearn.operators.selection import (
    correlation_filter,
    importance_filter,
    recursive_elimination,
    select_features,
    variance_filter,
)
from tablelearn.operators.splits import k_folds, random_split, split_shapes, time_split
from tablelearn.session import store
from workload import query
from workload.inputs import (
    DOCUMENT_FEATURES,
    DOUBLED_LINEITEM,
    doubled_lineitem,
    labelled_documents,
    rounded,
    table,
)

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price2", "const"]


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _pairs_sql() -> str:
    """One row per column pair i < j with its Pearson r (NULL for a constant)."""
    pairs = list(combinations(enumerate(_NUMERIC), 2))
    aggs = ", ".join(f"{_corr(a, b)} AS r_{i}_{j}" for (i, a), (j, b) in pairs)
    values = ", ".join(f"({i}, {j}, '{a}', '{b}', r_{i}_{j})" for (i, a), (j, b) in pairs)
    return f"""{DOUBLED_LINEITEM}, c AS (SELECT {aggs} FROM doubled),
pairs AS (SELECT u.* FROM c, LATERAL (VALUES {values}) AS u(i, j, "left", "right", r))"""


@query(f'WITH {_pairs_sql()} SELECT i, j, "left", "right", round(r, 6) + 0.0 AS r FROM pairs')
def correlation_matrix(spark, folder):
    return rounded(stats.correlations(doubled_lineitem(spark, folder), _NUMERIC))


@query(
    """WITH cells AS (
  SELECT a.i, b.j, embedding[a.i + 1]::DOUBLE AS x, embedding[b.j + 1]::DOUBLE AS y
  FROM embeddings, range(0, 64) AS a(i), range(0, 64) AS b(j) WHERE a.i < b.j)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(corr(x, y), 6) + 0.0 AS r FROM cells GROUP BY i, j"""
)
def correlation_matrix_wide(spark, folder):
    """All pairs of 64 columns by matrix products inside the tasks."""
    vectors = table(spark, folder, "embeddings")
    wide = vectors.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(stats.correlations(wide, wide.columns).select("i", "j", "r"))


@query(
    f"""WITH {_pairs_sql()},
first AS (SELECT "right" AS feature, arg_min("left", i) AS earlier FROM pairs WHERE abs(r) > 0.95 GROUP BY "right"),
names AS (SELECT unnest({_NUMERIC + ["l_returnflag"]}) AS feature)
SELECT feature, earlier IS NULL AS selected, 'Correlated (>0.95) with ' || earlier AS reason
FROM names LEFT JOIN first USING (feature)"""
)
def correlated_columns(spark, folder):
    df = doubled_lineitem(spark, folder)
    return correlation_filter(df).rows(df)


@query(
    f"""WITH {DOUBLED_LINEITEM},
s AS (SELECT {", ".join(f"var_samp({c}) AS {c}" for c in _NUMERIC)} FROM doubled)
SELECT u.feature AS feature, coalesce(NOT u.v < 0.01, true) AS selected
FROM s, LATERAL (VALUES {", ".join(f"('{c}', {c})" for c in _NUMERIC)}, ('l_returnflag', NULL)) AS u(feature, v)"""
)
def low_variance_columns(spark, folder):
    df = doubled_lineitem(spark, folder)
    return variance_filter(df).rows(df).select("feature", "selected")


@query(
    f"""WITH {_pairs_sql()},
gone AS (SELECT DISTINCT "right" AS feature FROM pairs WHERE abs(r) > 0.95),
s AS (SELECT {", ".join(f"var_samp({c}) AS {c}" for c in _NUMERIC if c != "l_quantity")} FROM doubled),
kept AS (SELECT u.* FROM s, LATERAL (VALUES {", ".join(f"('{c}', {c})" for c in _NUMERIC if c != "l_quantity")},
  ('l_returnflag', NULL)) AS u(feature, v))
SELECT feature FROM kept WHERE feature NOT IN (SELECT feature FROM gone) AND coalesce(NOT v < 0.01, true)"""
)
def selected_columns(spark, folder):
    df = doubled_lineitem(spark, folder)
    chosen = select_features(df, "l_quantity", task="regression").selected
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


_FLAGS = {"many": "l_quantity > 25", "cheap": "l_discount > 0.05", "late": "l_linenumber > 3", "taxed": "l_tax > 0.04"}

# What one split on a flag explains: the variance between its two groups.
_GAINS = f"""flags AS (SELECT l_extendedprice AS y, {", ".join(f"({rule})::INTEGER AS {c}" for c, rule in _FLAGS.items())}
  FROM lineitem),
gains AS ({" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, corr(y, {c}) ** 2 AS gain FROM flags" for i, c in enumerate(_FLAGS)
)}),
ranked AS (SELECT feature, position, row_number() OVER (ORDER BY gain DESC) AS place FROM gains),
order_of AS (SELECT feature, place, row_number() OVER (ORDER BY (place > 1)::INTEGER, position) AS rank FROM ranked)"""


def _flags(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select(F.col("l_extendedprice").alias("y"), *[F.expr(rule).cast("int").alias(c) for c, rule in _FLAGS.items()])


def _stump():
    """A tree of one split: only its column has any importance."""
    return DecisionTreeRegressor(featuresCol="features", labelCol="__label", maxDepth=1)


@query(
    f"""WITH {_GAINS}
SELECT feature, rank <= 2 AS selected, CASE WHEN rank > 2 THEN 'Importance rank ' || rank || '/4' END AS reason FROM order_of"""
)
def columns_by_one_split(spark, folder):
    """The best single split decides; columns of no importance rank by position."""
    df = _flags(spark, folder)
    return importance_filter(df, "y", model=_stump(), top_k=2, task="regression").rows(df)


@query(
    f"""WITH {_GAINS}, others AS (
  SELECT feature, row_number() OVER (ORDER BY position) AS gone FROM ranked WHERE place > 1)
SELECT feature, gone IS NULL AS selected, 'RFE ranking ' || (5 - gone) AS reason FROM ranked LEFT JOIN others USING (feature)"""
)
def elimination_by_one_split(spark, folder):
    """Every round drops the first column without importance, until the best is left."""
    df = _flags(spark, folder)
    return recursive_elimination(df, "y", model=_stump(), min_features=1, task="regression").rows(df)


@query()
def important_columns(spark, folder):
    df = store(labelled_documents(spark, folder).select(*DOCUMENT_FEATURES, "quality"))
    return importance_filter(df, "quality", top_k=3).rows(df)


@query()
def recursive_selection(spark, folder):
    df = store(labelled_documents(spark, folder).select(*DOCUMENT_FEATURES, "quality"))
    return recursive_elimination(df, "quality", min_features=4).rows(df)


_PRICED = ["l_quantity", "l_extendedprice", "l_discount"]


def _digits(column: str) -> int:
    """Digits of a mean that are free of summation noise and of ties."""
    return 3 if column == "l_extendedprice" else 7


@query(
    "SELECT u.* FROM (SELECT count(*) AS n, "
    + ", ".join(
        f"avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_s, min({c}) AS {c}_0, max({c}) AS {c}_1, median({c}) AS {c}_m, "
        f"quantile_cont({c}, 0.25) AS {c}_l, quantile_cont({c}, 0.75) AS {c}_h, var_samp({c}) AS {c}_v"
        for c in _PRICED
    )
    + " FROM lineitem) s, LATERAL (VALUES "
    + ", ".join(
        f"('{c}', n, round({c}_a, {_digits(c)}), round({c}_s, 4), {c}_0, {c}_1, round({c}_l, 4), round({c}_m, 4), "
        f"round({c}_h, 4), round({c}_v, 3))"
        for c in _PRICED
    )
    + ') AS u("column", n, mean, std, "min", "max", q25, median, q75, variance)'
)
def column_statistics(spark, folder):
    df = table(spark, folder, "lineitem")
    m, q, v = stats.moments(df, _PRICED), stats.quantiles(df, _PRICED, [0.25, 0.5, 0.75]), stats.variances(df, _PRICED)
    rows = [(c, m[c]["n"], m[c]["mean"], m[c]["std"], m[c]["min"], m[c]["max"], *q[c], v[c]) for c in _PRICED]
    found = spark.createDataFrame(
        rows,
        "column string, n long, mean double, std double, min double, max double, q25 double, median double, "
        "q75 double, variance double",
    )
    mean = F.round("mean", 7)
    for c in _PRICED:
        mean = F.when(F.col("column") == c, F.round("mean", _digits(c))).otherwise(mean)
    return found.select(
        "column", "n", mean.alias("mean"), F.round("std", 4).alias("std"), "min", "max",
        *[F.round(x, 4).alias(x) for x in ("q25", "median", "q75")], F.round("variance", 3).alias("variance"),
    )


@query("SELECT median(l_extendedprice) AS q50, quantile_cont(l_extendedprice, 0.01) AS q01 FROM lineitem")
def searched_quantiles(spark, folder):
    """Quantiles by narrowing intervals, as on columns too long for one task."""
    q = stats.quantiles(table(spark, folder, "lineitem"), ["l_extendedprice"], [0.5, 0.01], limit=1_000)
    return spark.createDataFrame([tuple(q["l_extendedprice"])], "q50 double, q01 double")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def ranked_orders(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(df, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "rank")


# ---------------------------------------------------------------- splits


def _parts_sql(hashed: str, source: str, key: str) -> str:
    return f"""WITH hashed AS (SELECT {key}, row_number() OVER (ORDER BY {hashed}) AS r, count(*) OVER () AS n FROM {source}),
sizes AS (SELECT *, ceil(0.2::DOUBLE * n) AS t FROM hashed),
parts AS (SELECT *, ceil((0.1::DOUBLE / (1 - 0.2::DOUBLE)) * (n - t)) AS v FROM sizes)
SELECT {key}, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM parts"""


@query(_parts_sql("md5('42-' || o_orderkey)", "orders", "o_orderkey"))
def split_random(spark, folder):
    df = table(spark, folder, "orders")
    return random_split(df, "o_totalprice", keys=["o_orderkey"]).select("o_orderkey", "split")


_STRATIFIED = """WITH n AS (SELECT count(*) AS n, ceil(0.2::DOUBLE * count(*)) AS t FROM orders),
counts AS (SELECT o_orderstatus AS c, count(*) AS size FROM orders GROUP BY 1),
share AS (SELECT c, size, n, t, size::DOUBLE / n::DOUBLE * (n - t)::DOUBLE AS x FROM counts, n),
kept AS (SELECT *, (floor(x) + (row_number() OVER (ORDER BY floor(x) - x, c)
                    <= (n - t) - sum(floor(x)) OVER ())::INTEGER)::BIGINT AS keep FROM share),
rest AS (SELECT *, n - t AS m, ceil((0.1::DOUBLE / (1 - 0.2::DOUBLE)) * (n - t)) AS v FROM kept),
share2 AS (SELECT *, keep::DOUBLE / m::DOUBLE * (m - v)::DOUBLE AS y FROM rest),
final AS (SELECT *, (floor(y) + (row_number() OVER (ORDER BY floor(y) - y, c)
                    <= (m - v) - sum(floor(y)) OVER ())::INTEGER)::BIGINT AS trained FROM share2),
ranked AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42-' || o_orderkey)) AS r FROM orders),
parts AS (SELECT o_orderkey, o_orderstatus, CASE WHEN r <= size - keep THEN 'test' WHEN r <= size - trained THEN 'val'
                 ELSE 'train' END AS split FROM ranked JOIN final ON c = o_orderstatus)
"""


@query(_STRATIFIED + "SELECT o_orderkey, split FROM parts")
def split_stratified(spark, folder):
    df = table(spark, folder, "orders")
    return random_split(df, "o_orderstatus", keys=["o_orderkey"]).select("o_orderkey", "split")


@query(_STRATIFIED + "SELECT split, count(*) AS n_rows, 2::BIGINT AS n_columns FROM parts GROUP BY split")
def split_sizes(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return split_shapes(random_split(df, "o_orderstatus", keys=["o_orderkey"]))


def _time_sql(source: str, key: str, time: str) -> str:
    return f"""WITH ranked AS (
  SELECT {key}, row_number() OVER (ORDER BY {time}, md5('0-' || {key})) AS r, count(*) OVER () AS n FROM {source})
SELECT {key}, CASE WHEN r <= floor(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train'
                   WHEN r <= floor(n * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ranked"""


@query(_time_sql("events", "event_id", "ts"))
def split_by_time(spark, folder):
    return time_split(table(spark, folder, "events"), "ts", keys=["event_id"]).select("event_id", "split")


@query(_time_sql("orders", "o_orderkey", "o_orderdate"))
def split_by_time_with_ties(spark, folder):
    df = table(spark, folder, "orders")
    return time_split(df, "o_orderdate", keys=["o_orderkey"], limit=1_000).select("o_orderkey", "split")


@query(
    """WITH ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id)) - 1 AS p, count(*) OVER () AS n FROM documents),
sizes AS (SELECT *, n % 5 AS extra, n // 5 AS size FROM ranked)
SELECT doc_id, (CASE WHEN p < extra * (size + 1) THEN p // (size + 1)
                ELSE extra + (p - extra * (size + 1)) // size END)::INTEGER AS fold FROM sizes"""
)
def folds_random(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "n_chars")
    return k_folds(df, "n_chars", 5, stratify=False, keys=["doc_id"]).select("doc_id", "fold")


_FOLD = "(start + n + 4 - {f}) // 5 - (start + 4 - {f}) // 5"


@query(
    f"""WITH counts AS (SELECT quality::VARCHAR AS c, count(*) AS n FROM labels GROUP BY 1),
placed AS (SELECT c, n, coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
           AS start FROM counts),
cuts AS (SELECT c, {_FOLD.format(f=0)} AS f0, {_FOLD.format(f=1)} AS f1, {_FOLD.format(f=2)} AS f2,
                {_FOLD.format(f=3)} AS f3 FROM placed),
ranked AS (SELECT doc_id, quality::VARCHAR AS c,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42-' || doc_id)) AS r FROM labels)
SELECT doc_id, (r > f0)::INTEGER + (r > f0 + f1)::INTEGER + (r > f0 + f1 + f2)::INTEGER
       + (r > f0 + f1 + f2 + f3)::INTEGER AS fold
FROM ranked JOIN cuts USING (c)"""
)
def folds_stratified(spark, folder):
    df = table(spark, folder, "labels").select("doc_id", "quality")
    return k_folds(df, "quality", 5, keys=["doc_id"]).select("doc_id", "fold")
