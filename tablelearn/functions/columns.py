"""Column roles by type, and the missing-value convention."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (), booleans: bool = False) -> list[str]:
    """Numeric column names in table order; booleans only on request."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema
        if f.name not in skip
        and (is_number(f.dataType) or (booleans and isinstance(f.dataType, T.BooleanType)))
    ]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.StringType)]


def as_double(name: str) -> Column:
    """The column as a double; NaN counts as missing."""
    return F.nanvl(quoted(name).cast("double"), F.lit(None).cast("double"))


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is NULL or NaN."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return quoted(name).isNull() | F.isnan(quoted(name))
    return quoted(name).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN becomes NULL in every floating column."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floating else quoted(c)
            for c in df.columns
        ]
    )


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Projection in the given order; raises on a column that is not there."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")
    return df.select(*[quoted(c) for c in columns])


def divide(top: Column, bottom: Column) -> Column:
    """Division that yields NULL, not an error, on a zero denominator."""
    return F.when(bottom != 0, top / F.when(bottom != 0, bottom))
