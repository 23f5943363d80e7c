"""Imputation, encoding, scaling and derived features."""

from __future__ import annotations

from pyspark.ml import Pipeline

from tablelearn.operators.features import (
    DatetimeParts,
    DropMissing,
    FeatureChain,
    FillMissing,
    Interactions,
    LabelCodes,
    OneHot,
    Scale,
    TargetMeans,
)
from tablelearn.session import scratch_path
from workload import query
from workload.inputs import (
    DOUBLED_LINEITEM,
    GAPPY_EVENTS,
    doubled_lineitem,
    gappy_events,
    rounded,
    table,
)

_MODE = "(SELECT {c} FROM gappy WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
_MODE_TYPE, _MODE_VALUE = _MODE.format(c="event_type"), _MODE.format(c="value")


def _filled(value: str, kind: str = _MODE_TYPE) -> str:
    return f"""WITH {GAPPY_EVENTS}
SELECT event_id, user_id, round(coalesce(value, {value}), 6) AS value, coalesce(event_type, {kind}) AS event_type
FROM gappy"""


def _fill(spark, folder, strategy):
    df = gappy_events(spark, folder)
    return rounded(FillMissing(strategy, ["value", "event_type"]).fit(df).transform(df))


@query(_filled("(SELECT avg(value) FROM gappy)"))
def impute_mean(spark, folder):
    return _fill(spark, folder, "mean")


@query(_filled("(SELECT median(value) FROM gappy)"))
def impute_median(spark, folder):
    return _fill(spark, folder, "median")


@query(_filled(_MODE_VALUE))
def impute_mode(spark, folder):
    return _fill(spark, folder, "mode")


@query(f"WITH {GAPPY_EVENTS} SELECT * FROM gappy WHERE value IS NOT NULL")
def drop_missing_subset(spark, folder):
    return DropMissing(["value"]).transform(gappy_events(spark, folder))


@query(f"WITH {GAPPY_EVENTS} SELECT * FROM gappy WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing_any(spark, folder):
    return DropMissing().transform(gappy_events(spark, folder))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "SELECT c_custkey, "
    + ", ".join(f"(c_mktsegment = '{s}')::INTEGER::DOUBLE AS \"c_mktsegment_{s}\"" for s in _SEGMENTS)
    + " FROM customer"
)
def one_hot(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return OneHot(["c_mktsegment"]).fit(df).transform(df)


_SEEN = ["click", "purchase", "signup", "view"]


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "event_type", "value")


def _seen(df):
    return df.where("event_type <> 'error'")


@query(
    "SELECT event_id, value, "
    + ", ".join(f"(event_type = '{s}')::INTEGER::DOUBLE AS \"event_type_{s}\"" for s in _SEEN)
    + " FROM events"
)
def one_hot_unseen(spark, folder):
    df = _events(spark, folder)
    return OneHot(["event_type"]).fit(_seen(df)).transform(df)


@query(
    """SELECT o_orderkey, (SELECT count(DISTINCT p.o_orderpriority) FROM orders p
                    WHERE p.o_orderpriority < o.o_orderpriority) AS o_orderpriority
FROM orders o"""
)
def label_encode(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return LabelCodes(["o_orderpriority"]).fit(df).transform(df)


@query(
    """WITH codes AS (
  SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code
  FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))
SELECT event_id, value, coalesce(code, -1) AS event_type FROM events LEFT JOIN codes USING (event_type)"""
)
def label_encode_unseen(spark, folder):
    df = _events(spark, folder)
    return LabelCodes(["event_type"]).fit(_seen(df)).transform(df)


@query(
    f"""WITH {GAPPY_EVENTS}, filled AS (SELECT event_id, coalesce(event_type, 'nan') AS event_type FROM gappy)
SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type FROM filled"""
)
def label_encode_missing(spark, folder):
    df = gappy_events(spark, folder).select("event_id", "event_type")
    return LabelCodes(["event_type"]).fit(df).transform(df)


@query(
    """SELECT dense_rank() OVER (ORDER BY url) - 1 AS url,
       dense_rank() OVER (ORDER BY page_id::VARCHAR) - 1 AS page_id
FROM pages"""
)
def label_encode_many(spark, folder):
    """Columns with about as many categories as rows."""
    df = table(spark, folder, "pages").select("url", "page_id")
    return LabelCodes(["url", "page_id"]).fit(df).transform(df)


@query(
    """SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS p_brand,
       round(avg(p_retailprice) OVER (PARTITION BY p_type), 6) AS p_type, p_retailprice
FROM part"""
)
def target_encode(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return rounded(TargetMeans("p_retailprice", ["p_brand", "p_type"]).fit(df).transform(df))


@query(
    """WITH seen AS (SELECT event_type, value FROM events WHERE event_type <> 'error'),
means AS (SELECT event_type, avg(value) AS m FROM seen GROUP BY event_type)
SELECT event_id, value, round(coalesce(m, (SELECT avg(value) FROM seen)), 6) AS event_type
FROM events LEFT JOIN means USING (event_type)"""
)
def target_encode_unseen(spark, folder):
    df = _events(spark, folder)
    return rounded(TargetMeans("value", ["event_type"]).fit(_seen(df)).transform(df))


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "const"]


def _scale_sql(centre: str, width: str) -> str:
    stats = ", ".join(f"{centre.format(c=c)} AS {c}_c, {width.format(c=c)} AS {c}_w" for c in _SCALED)
    out = ", ".join(f"round(({c} - {c}_c) / CASE WHEN {c}_w = 0 THEN 1 ELSE {c}_w END, 6) + 0.0 AS {c}" for c in _SCALED)
    return f"WITH {DOUBLED_LINEITEM}, s AS (SELECT {stats} FROM doubled) SELECT {out} FROM doubled, s"


def _scale(spark, folder, strategy):
    df = doubled_lineitem(spark, folder).select(*_SCALED)
    return rounded(Scale(strategy).fit(df).transform(df))


@query(_scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, folder):
    return _scale(spark, folder, "standard")


@query(_scale_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, folder):
    return _scale(spark, folder, "minmax")


@query(_scale_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scale_robust(spark, folder):
    return _scale(spark, folder, "robust")


@query(
    """SELECT event_id, hour(ts) AS ts_hour, day(ts) AS ts_day, month(ts) AS ts_month, isodow(ts) - 1 AS ts_dayofweek,
       (isodow(ts) >= 6)::BIGINT AS ts_is_weekend
FROM events"""
)
def datetime_features(spark, folder):
    return DatetimeParts("ts").transform(table(spark, folder, "events").select("event_id", "ts"))


@query(
    """SELECT l_quantity, l_extendedprice, l_linenumber,
       round(l_quantity * l_extendedprice, 4) AS l_quantity_x_l_extendedprice,
       round(l_quantity * l_linenumber, 4) AS l_quantity_x_l_linenumber,
       round(l_extendedprice * l_linenumber, 4) AS l_extendedprice_x_l_linenumber
FROM lineitem"""
)
def interactions(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_linenumber"]
    df = table(spark, folder, "lineitem").select(*columns)
    return rounded(Interactions(columns).transform(df), 4)


_CHAIN = f"""WITH {GAPPY_EVENTS},
filled AS (SELECT event_id, user_id, coalesce(value, (SELECT median(value) FROM gappy)) AS value,
                  coalesce(event_type, {_MODE_TYPE}) AS event_type FROM gappy),
coded AS (SELECT event_id, user_id, value, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS event_type FROM filled),
s AS (SELECT avg(user_id) AS ua, stddev_pop(user_id) AS us, avg(value) AS va, stddev_pop(value) AS vs,
             avg(event_type) AS ta, stddev_pop(event_type) AS ts FROM coded)
SELECT event_id, round((user_id - ua) / us, 6) + 0.0 AS user_id, round((value - va) / vs, 6) + 0.0 AS value,
       round((event_type - ta) / ts, 6) + 0.0 AS event_type
FROM coded, s"""


def _chain():
    chain = FeatureChain().add_step("fill", "handle_missing", strategy="median")
    return chain.add_step("code", "encode_categorical", strategy="label").add_step("scale", "scale_numeric")


@query(_CHAIN)
def feature_chain(spark, folder):
    return rounded(_chain().fit_transform(gappy_events(spark, folder), exclude=["event_id"]))


@query(_CHAIN)
def saved_feature_chain(spark, folder):
    """The chain after a round trip through storage, dictionaries included."""
    df = gappy_events(spark, folder)
    path = scratch_path(spark, "chain")
    _chain().fit(df, exclude=["event_id"]).save(path)
    return rounded(FeatureChain.load(path).transform(df))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "WITH flags AS (SELECT o_orderkey, o_totalprice, "
    + ", ".join(f"(o_orderpriority = '{p}')::INTEGER::DOUBLE AS f{i}" for i, p in enumerate(_PRIORITIES))
    + " FROM orders), s AS (SELECT min(o_totalprice) AS p0, max(o_totalprice) AS p1, "
    + ", ".join(f"min(f{i}) AS a{i}, max(f{i}) AS b{i}" for i in range(5))
    + " FROM flags) SELECT o_orderkey, round((o_totalprice - p0) / (p1 - p0), 6) AS o_totalprice, "
    + ", ".join(f"round((f{i} - a{i}) / (b{i} - a{i}), 6) AS \"o_orderpriority_{p}\"" for i, p in enumerate(_PRIORITIES))
    + " FROM flags, s"
)
def feature_chain_one_hot(spark, folder):
    """Scaling after one-hot also scales the new columns."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    spared = ["o_orderkey"]
    stages = [FillMissing("mean", exclude=spared), OneHot(exclude=spared), Scale("minmax", exclude=spared)]
    return rounded(Pipeline(stages=stages).fit(df).transform(df))


@query(
    """WITH parts AS (
  SELECT o_orderkey, o_totalprice, month(o_orderdate) AS o_orderdate_month, isodow(o_orderdate) - 1 AS o_orderdate_dayofweek
  FROM orders)
SELECT o_orderkey, o_totalprice, o_orderdate_month, o_orderdate_dayofweek,
       round(o_totalprice * o_orderdate_month, 4) AS o_totalprice_x_o_orderdate_month
FROM parts"""
)
def chain_of_stateless_steps(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    chain = FeatureChain().add_step("time", "create_datetime_features", column="o_orderdate")
    chain.add_step("products", "create_interaction_features", columns=["o_totalprice", "o_orderdate_month"])
    out = chain.fit_transform(df)
    return rounded(out.drop("o_orderdate_hour", "o_orderdate_day", "o_orderdate_is_weekend"), 4)
