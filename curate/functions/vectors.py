"""Column expressions on arrays of numbers. All arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.session import as_column


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def doubles(vector: str | Column) -> Column:
    return as_column(vector).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null when one of the vectors is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def softmax(scores: str | Column) -> Column:
    """Probabilities from scores, shifted by the maximum against overflow."""
    scores = doubles(scores)
    exps = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(exps, lambda es: let(_sum(es), lambda total: F.transform(es, lambda e: e / total)))


def sigmoid(scores: str | Column) -> Column:
    return F.transform(doubles(scores), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def label_map(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def softmax_top(
    rows: DataFrame, scores: str, names: Sequence[str], already_probs: bool = False
) -> DataFrame:
    """Add the most probable class: ``top_index``, ``label`` (null if unnamed), ``confidence``."""
    rows = rows.withColumn("_probs", doubles(scores) if already_probs else softmax(scores))
    rows = rows.withColumn("confidence", F.array_max("_probs"))
    rows = rows.withColumn(
        "top_index", F.nullif(F.array_position("_probs", F.col("confidence")), F.lit(0)).cast("int") - 1
    )
    return rows.withColumn("label", F.get(label_map(names), F.col("top_index"))).drop("_probs")


def sigmoid_labels(rows: DataFrame, scores: str, names: Sequence[str], threshold: float) -> DataFrame:
    """Add ``labels``: every class whose own probability reaches the threshold, maybe none."""
    named = F.arrays_zip(label_map(names).alias("name"), sigmoid(scores).alias("p"))
    kept = F.filter(named, lambda x: x["p"] >= threshold)
    return rows.withColumn("labels", F.transform(kept, lambda x: x["name"]))


def payload_struct(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """Record layout of a vector collection: id, vector and everything else as one struct."""
    rest = [c for c in rows.columns if c not in (vector, key)]
    return rows.select(key, vector, F.struct(*rest).alias("payload"))
