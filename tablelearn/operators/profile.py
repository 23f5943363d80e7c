"""Validation and profiling: one aggregate over the table, rules on its one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelearn.functions.columns import is_moment, is_number, missing, quoted
from tablelearn.functions.stats import distinct_counts, rows_and_distinct

ISSUE = "check string, column string, message string, severity string"
STATISTICS = "column string, dtype string, n_rows long, n_columns long, null_count long"

# Type names users bring from other table libraries, beside Spark's own.
TYPE_ALIASES = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64",
                "float": "float32", "string": "object", "boolean": "bool", "timestamp": "datetime64",
                "timestamp_ntz": "datetime64"}

# The limits that decide a column's role.
FEW_NUMBERS = 15
FEW_NUMBERS_SHARE = 0.05
MANY_STRINGS = 50
MANY_CLASSES = 50

# The texts of issues.
NO_COLUMN = "Missing expected column: {column}"
WRONG_TYPE = "Column {column}: expected dtype {wanted}, got {seen}"
EMPTY = "DataFrame is empty"
NULLS = "Column {column}: %.1f%% null (max {limit}%)"
NO_RANGE_COLUMN = "Column {column} not found for range check"
NOT_NUMERIC = "Column {column} is not numeric"


def _issue(check: str, column: str | None, message: Column, severity: str = "error") -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
    )


def _rows(one_row: DataFrame, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One issue row per rule that holds on the single row of statistics."""
    if not rules:
        return one_row.sparkSession.createDataFrame([], ISSUE)
    flagged = F.array(*[F.when(F.coalesce(holds, F.lit(False)), issue) for holds, issue in rules])
    return one_row.select(F.inline(F.filter(flagged, lambda i: i.isNotNull())))


class _Plan:
    """Statistics to compute together and the rules that read them."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggs: dict[str, Column] = {"n": F.count(F.lit(1))}
        self.rules: list[tuple[Column, Column]] = []

    def stat(self, key: str, agg: Column) -> Column:
        self.aggs.setdefault(key, agg)
        return F.col(key)

    def row(self) -> DataFrame:
        return self.df.agg(*[a.alias(k) for k, a in self.aggs.items()])

    def issues(self) -> DataFrame:
        return _rows(self.row(), self.rules)

    def schema(self, expected: Sequence[str], dtypes: Mapping[str, str] | None) -> None:
        present = dict(self.df.dtypes)
        for c in expected:
            if c not in present:
                self.rules.append((F.lit(True), _issue("schema", c, F.lit(NO_COLUMN.format(column=c)))))
        for c, wanted in (dtypes or {}).items():
            if c not in present:
                continue
            names = {present[c], TYPE_ALIASES.get(present[c], present[c])}
            if not any(wanted in name for name in names):
                text = WRONG_TYPE.format(column=c, wanted=wanted, seen=present[c])
                self.rules.append((F.lit(True), _issue("schema", c, F.lit(text), "warning")))

    def completeness(self, max_null_pct: float) -> None:
        n = F.col("n")
        self.rules.append((n == 0, _issue("completeness", None, F.lit(EMPTY))))
        for i, c in enumerate(self.df.columns):
            absent = self.stat(f"null_{i}", F.count_if(missing(self.df, c)))
            share = absent / F.when(n > 0, n)
            text = F.format_string(NULLS.format(column=_escaped(c), limit=f"{max_null_pct:.1%}"), share * 100)
            self.rules.append((share > max_null_pct, _issue("completeness", c, text)))

    def ranges(self, limits: Mapping[str, tuple[float, float]]) -> None:
        fields = {f.name: f.dataType for f in self.df.schema}
        for i, (c, (low, high)) in enumerate(limits.items()):
            if c not in fields:
                self.rules.append((F.lit(True), _issue("range", c, F.lit(NO_RANGE_COLUMN.format(column=c)))))
                continue
            if not is_number(fields[c]) and not isinstance(fields[c], T.BooleanType):
                text = F.lit(NOT_NUMERIC.format(column=c))
                self.rules.append((F.lit(True), _issue("range", c, text, "warning")))
                continue
            x = quoted(c) if is_number(fields[c]) else quoted(c).cast("int")
            if isinstance(fields[c], (T.DoubleType, T.FloatType)):
                x = F.when(~F.isnan(x), x)
            least, most = self.stat(f"min_{i}", F.min(x)), self.stat(f"max_{i}", F.max(x))
            for seen, bad, word, sign, limit in (
                (least, least < low, "min", "<", low),
                (most, most > high, "max", ">", high),
            ):
                text = F.concat(F.lit(f"Column {c}: {word} value "), seen.cast("string"), F.lit(f" {sign} {limit}"))
                self.rules.append((bad, _issue("range", c, text)))


def _escaped(name: str) -> str:
    return name.replace("%", "%%")


def validate_schema(
    df: DataFrame, expected_columns: Sequence[str], dtypes: Mapping[str, str] | None = None
) -> DataFrame:
    """Missing columns (errors) and unexpected types (warnings); reads no data."""
    plan = _Plan(df)
    plan.schema(expected_columns, dtypes)
    return _rows(df.sparkSession.range(1), plan.rules)


def validate_completeness(df: DataFrame, max_null_pct: float = 0.1) -> DataFrame:
    """Columns whose share of nulls exceeds the limit; one issue for an empty table."""
    plan = _Plan(df)
    plan.completeness(max_null_pct)
    return plan.issues()


def validate_ranges(df: DataFrame, column_ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Columns with values outside their inclusive range."""
    plan = _Plan(df)
    plan.ranges(column_ranges)
    return plan.issues()


@dataclass(frozen=True)
class ValidationReport:
    """Issues and per-column statistics, both as DataFrames."""

    issues: DataFrame
    stats: DataFrame

    def severity_counts(self) -> DataFrame:
        return self.issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))

    def _count(self, severity: str) -> int:
        return self.issues.where(F.col("severity") == severity).count()

    @property
    def error_count(self) -> int:
        return self._count("error")

    @property
    def warning_count(self) -> int:
        return self._count("warning")

    @property
    def is_valid(self) -> bool:
        return self.error_count == 0


def validate(
    df: DataFrame,
    expected_columns: Sequence[str] | None = None,
    dtypes: Mapping[str, str] | None = None,
    max_null_pct: float = 0.1,
    column_ranges: Mapping[str, tuple[float, float]] | None = None,
) -> ValidationReport:
    """All checks and statistics from a single scan: schema, completeness, ranges.

    The scan runs at once; reading the report costs nothing more.
    """
    plan = _Plan(df)
    if expected_columns is not None:
        plan.schema(expected_columns, dtypes)
    plan.completeness(max_null_pct)
    if column_ranges:
        plan.ranges(column_ranges)
    lazy = plan.row()
    row = df.sparkSession.createDataFrame(lazy.toArrow(), schema=lazy.schema)
    return ValidationReport(_rows(row, plan.rules), _statistics(df, row))


def profile(df: DataFrame) -> DataFrame:
    """``column, dtype, n_rows, n_columns, null_count`` for every column, one scan."""
    plan = _Plan(df)
    plan.completeness(1.0)
    return _statistics(df, plan.row())


def _statistics(df: DataFrame, row: DataFrame) -> DataFrame:
    if not df.columns:
        return df.sparkSession.createDataFrame([], STATISTICS)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(dtype).alias("dtype"),
            F.col("n").alias("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.col(f"null_{i}").alias("null_count"),
        )
        for i, (c, dtype) in enumerate(df.dtypes)
    ]
    return row.select(F.inline(F.array(*cells)))


@dataclass(frozen=True)
class ColumnRoles:
    """Column names by the role they play, each list in table order."""

    numeric: list[str]
    categorical: list[str]
    datetime: list[str]
    text: list[str]

    def rows(self, df: DataFrame) -> DataFrame:
        pairs = [(c, role) for role in ("numeric", "categorical", "datetime", "text") for c in getattr(self, role)]
        return df.sparkSession.createDataFrame(pairs, "column string, role string")


def detect_roles(df: DataFrame) -> ColumnRoles:
    """Role of every column from its type and its number of distinct values."""
    fields = {f.name: f.dataType for f in df.schema}
    counted = [c for c, t in fields.items() if is_number(t) or isinstance(t, (T.StringType, T.BooleanType))]
    n, distinct = rows_and_distinct(df, counted)
    roles = ColumnRoles([], [], [], [])
    for c, kind in fields.items():
        if is_moment(kind):
            roles.datetime.append(c)
        elif is_number(kind) or isinstance(kind, T.BooleanType):
            few = distinct[c] < FEW_NUMBERS and distinct[c] / max(n, 1) < FEW_NUMBERS_SHARE
            (roles.categorical if few else roles.numeric).append(c)
        elif isinstance(kind, T.StringType):
            (roles.text if distinct[c] > MANY_STRINGS else roles.categorical).append(c)
        else:
            roles.categorical.append(c)
    return roles


def is_stratifiable(df: DataFrame, column: str) -> bool:
    """Whether a target has classes: any string, or fewer than 50 distinct values."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return True
    return distinct_counts(df, [column])[column] < MANY_CLASSES
