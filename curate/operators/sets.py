"""Stacking of differently shaped tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_typed(named: dict[str, DataFrame]) -> DataFrame:
    """Stack tables under a ``type`` column; a column that one of them lacks is null there."""
    typed = [rows.withColumn("type", F.lit(name)) for name, rows in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)


def concat_batches(batches: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), batches)
