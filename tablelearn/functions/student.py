"""Two-sided p-value of Student's t for whole degrees of freedom, as a Column.

Finite trigonometric series, Abramowitz and Stegun 26.7.3 and 26.7.4.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def two_sided_p(t: Column, dof: Column) -> Column:
    angle = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    cos2 = F.cos(angle) * F.cos(angle)
    odd = dof % 2 == 1
    steps = F.floor(F.when(odd, (dof - 3) / 2).otherwise((dof - 2) / 2)).cast("int")

    def add(state: Column, j: Column) -> Column:
        j = j.cast("double")
        factor = F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        term = state["term"] * cos2 * factor
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    series = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("total")),
        add,
        lambda state: state["total"],
    )
    inside = (
        F.when(dof == 1, 2 * angle / F.pi())
        .when(odd, 2 / F.pi() * (angle + F.sin(angle) * series))
        .otherwise(F.sin(angle) * series)
    )
    return F.when((dof >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))
