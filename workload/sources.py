"""Readers and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelearn.functions.columns import keep_columns, numeric_only
from tablelearn.operators.profile import (
    detect_roles,
    is_stratifiable,
    profile,
    validate,
    validate_completeness,
    validate_ranges,
)
from tablelearn.session import scratch_path
from tablelearn.sources.readers import read_csv, read_json_payload, read_source
from workload import query
from workload.inputs import GAPPY_EVENTS, gappy_events, table


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_source(spark, folder):
    return keep_columns(read_source(spark, f"{folder}/orders.parquet"), ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, folder):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, folder, "customer").write.option("header", True).csv(path)
    back = read_source(spark, path)
    return back.withColumn("c_custkey", F.col("c_custkey").cast("long")).withColumn(
        "c_nationkey", F.col("c_nationkey").cast("long")
    )


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_semicolon(spark, folder):
    path = scratch_path(spark, "supplier")
    columns = ["s_suppkey", "s_name", "s_acctbal"]
    table(spark, folder, "supplier").select(*columns).write.option("header", True).option("sep", ";").csv(path)
    return read_csv(spark, path, schema="s_suppkey long, s_name string, s_acctbal double", sep=";")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def json_objects(spark, folder):
    path = scratch_path(spark, "orders")
    table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").write.json(path)
    return read_json_payload(spark, path, lines=True)


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def json_data_pages(spark, folder):
    """Pages of at most 100 records under ``data``, as an API returns them."""
    path = scratch_path(spark, "pages")
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    pages = rows.groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(
        F.collect_list(F.struct(*rows.columns)).alias("data")
    )
    pages.write.json(path)
    return read_json_payload(spark, path, lines=True)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def numeric_projection(spark, folder):
    return numeric_only(table(spark, folder, "customer"))


@query(
    f"""WITH {GAPPY_EVENTS}, s AS (SELECT count(*) AS n, count(value) AS v, count(event_type) AS t FROM gappy)
SELECT u.name AS "column", n AS n_rows, 4::BIGINT AS n_columns, u.missing AS null_count
FROM s, LATERAL (VALUES ('event_id', 0::BIGINT), ('user_id', 0::BIGINT), ('value', n - v), ('event_type', n - t))
  AS u(name, missing)"""
)
def profile_stats(spark, folder):
    return profile(gappy_events(spark, folder)).select("column", "n_rows", "n_columns", "null_count")


@query(
    f"""WITH {GAPPY_EVENTS}, s AS (
  SELECT 1 - count(value) / count(*) AS v, 1 - count(event_type) / count(*) AS t FROM gappy)
SELECT 'completeness' AS "check", u.name AS "column", 'error' AS severity
FROM s, LATERAL (VALUES ('value', v), ('event_type', t)) AS u(name, share) WHERE share > 0.1"""
)
def null_completeness(spark, folder):
    return validate_completeness(gappy_events(spark, folder), 0.1).select("check", "column", "severity")


_LINEITEM_RANGES = {
    "l_quantity": (5, 40),
    "l_discount": (0.0, 0.1),
    "l_tax": (-1, 0.07),
    "l_returnflag": (0, 1),
    "l_margin": (0, 1),
}


@query(
    """WITH s AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1,
                  min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem)
SELECT 'range' AS "check", u.name AS "column", u.message AS message, u.severity AS severity
FROM s, LATERAL (VALUES
  ('l_quantity', q0 < 5, 'Column l_quantity: min value ' || q0::VARCHAR || ' < 5', 'error'),
  ('l_quantity', q1 > 40, 'Column l_quantity: max value ' || q1::VARCHAR || ' > 40', 'error'),
  ('l_discount', d0 < 0, 'Column l_discount: min value ' || d0::VARCHAR || ' < 0.0', 'error'),
  ('l_discount', d1 > 0.1, 'Column l_discount: max value ' || d1::VARCHAR || ' > 0.1', 'error'),
  ('l_tax', t0 < -1, 'Column l_tax: min value ' || t0::VARCHAR || ' < -1', 'error'),
  ('l_tax', t1 > 0.07, 'Column l_tax: max value ' || t1::VARCHAR || ' > 0.07', 'error'),
  ('l_returnflag', true, 'Column l_returnflag is not numeric', 'warning'),
  ('l_margin', true, 'Column l_margin not found for range check', 'error')) AS u(name, bad, message, severity)
WHERE u.bad"""
)
def range_issues(spark, folder):
    return validate_ranges(table(spark, folder, "lineitem"), _LINEITEM_RANGES)


def _report(spark, folder):
    return validate(
        gappy_events(spark, folder),
        expected_columns=["event_id", "value", "region"],
        dtypes={"event_id": "int", "user_id": "float"},
        max_null_pct=0.1,
        column_ranges={"value": (0, 100), "event_type": (0, 1)},
    )


_REPORT_SQL = f"""WITH {GAPPY_EVENTS},
s AS (SELECT 1 - count(value) / count(*) AS v, 1 - count(event_type) / count(*) AS t,
             min(value) AS low, max(value) AS high FROM gappy),
issues AS (
  SELECT u.kind AS "check", u.name AS "column", u.severity AS severity
  FROM s, LATERAL (VALUES
    ('schema', 'region', 'error', true), ('schema', 'user_id', 'warning', true),
    ('completeness', 'value', 'error', v > 0.1), ('completeness', 'event_type', 'error', t > 0.1),
    ('range', 'value', 'error', low < 0), ('range', 'value', 'error', high > 100),
    ('range', 'event_type', 'warning', true)) AS u(kind, name, severity, bad)
  WHERE u.bad)
"""


@query(_REPORT_SQL + 'SELECT "check", "column", severity FROM issues')
def validation_report(spark, folder):
    return _report(spark, folder).issues.select("check", "column", "severity")


@query(_REPORT_SQL + "SELECT severity, count(*) AS n FROM issues GROUP BY severity")
def severity_counts(spark, folder):
    return _report(spark, folder).severity_counts()


def _role_sql(name: str, columns: dict[str, str]) -> str:
    """SQL for the role of every column of one table, given each column's kind."""
    parts = []
    for c, kind in columns.items():
        if kind == "time":
            role = "min('datetime')"
        elif kind == "number":
            few = f"count(DISTINCT {c}) < 15 AND count(DISTINCT {c}) / greatest(count(*), 1) < 0.05"
            role = f"CASE WHEN {few} THEN 'categorical' ELSE 'numeric' END"
        else:
            role = f"CASE WHEN count(DISTINCT {c}) > 50 THEN 'text' ELSE 'categorical' END"
        parts.append(f"SELECT '{name}' AS source, '{c}' AS \"column\", {role} AS role FROM {name}")
    return "\nUNION ALL ".join(parts)


_ROLE_TABLES = {
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number",
               "o_orderdate": "time", "o_orderpriority": "text"},
    "part": {"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number",
             "p_retailprice": "number"},
    "events": {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number",
               "props": "text"},
    "lineitem": {"l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number",
                 "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number",
                 "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
}


@query("\nUNION ALL ".join(_role_sql(t, c) for t, c in _ROLE_TABLES.items()))
def detect_column_roles(spark, folder):
    out = None
    for name in _ROLE_TABLES:
        df = table(spark, folder, name)
        rows = detect_roles(df).rows(df).select(F.lit(name).alias("source"), "column", "role")
        out = rows if out is None else out.unionByName(rows)
    return out


_TARGETS = [("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("part", "p_size"), ("lineitem", "l_linenumber"),
            ("lineitem", "l_quantity"), ("customer", "c_nationkey")]


@query(
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS source, '{c}' AS target, "
        + ("count(*) >= 0" if c == "o_orderstatus" else f"count(DISTINCT {c}) < 50")
        + f" AS stratifiable FROM {t}"
        for t, c in _TARGETS
    )
)
def stratifiable_targets(spark, folder):
    rows = [(t, c, is_stratifiable(table(spark, folder, t), c)) for t, c in _TARGETS]
    return spark.createDataFrame(rows, "source string, target string, stratifiable boolean")
