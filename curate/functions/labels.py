"""Class names and their indices, by declared order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_labels(rows: DataFrame, column: str, names: Sequence[str], name: str = "label_id") -> DataFrame:
    """Index of the class name in ``names``; unknown names and null give null."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return rows.withColumn(name, (F.nullif(position, F.lit(0)) - 1).cast("int"))


def decode_labels(rows: DataFrame, column: str, names: Sequence[str], name: str = "label") -> DataFrame:
    """Class name of an index (string indices are cast); an index without a name gives null."""
    index = F.col(column).try_cast("int")
    return rows.withColumn(name, F.when(index >= 0, F.get(F.array(*[F.lit(n) for n in names]), index)))
