"""Class labels as 0..k-1 and back, with the label's own type and natural order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.operators.features import JsonStage


def class_list(df: DataFrame, target: str) -> list:
    """Distinct labels in natural order. They reach the driver, as every classifier keeps its classes there."""
    found = df.select(quoted(target).alias("c")).where("c is not null").distinct().collect()
    return sorted(r["c"] for r in found)


class LabelIndex(JsonStage):
    """Add the class number of a label; rows without the label column pass unchanged."""

    def __init__(self, target: str = "", out: str = "__label", classes: Sequence = (), kind: str = "string"):
        super().__init__(target=target, out=out, classes=list(classes), kind=kind)

    def _transform(self, df: DataFrame) -> DataFrame:
        known = self.known
        if known["target"] not in df.columns:
            return df
        choices = F.array(*[F.lit(c).cast(known["kind"]) for c in known["classes"]])
        place = F.array_position(choices, quoted(known["target"]).cast(known["kind"])) - 1
        return df.withColumn(known["out"], F.when(place >= 0, place.cast("double")))


class LabelDecode(JsonStage):
    """Turn the predicted class number into the class, in the label's own type."""

    def __init__(self, classes: Sequence = (), kind: str = "string", column: str = "prediction"):
        super().__init__(classes=list(classes), kind=kind, column=column)

    def _transform(self, df: DataFrame) -> DataFrame:
        known = self.known
        choices = F.array(*[F.lit(c).cast(known["kind"]) for c in known["classes"]])
        column = known["column"]
        return df.withColumn(column, F.element_at(choices, quoted(column).cast("int") + 1))


def index_label(df: DataFrame, target: str, out: str = "__label", classes: Sequence | None = None):
    """The table with class numbers in ``out``, and the class list."""
    known = list(classes) if classes is not None else class_list(df, target)
    kind = df.schema[target].dataType
    return LabelIndex(target, out, known, kind.simpleString()).transform(df), known
