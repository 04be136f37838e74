"""Reproducible samples and splits: every choice follows an md5 of seed and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.operators.ordering import seeded_hash, smallest_hash_cutoffs
from curate.session import as_column, join_null_safe, materialize


def top_rows(rows: DataFrame, order: Sequence[str | Column], k: int, skip: int = 0) -> DataFrame:
    """The first ``k`` rows along a unique order, after ``skip``."""
    ordered = rows.orderBy(*[as_column(c) for c in order])
    return (ordered.offset(skip) if skip else ordered).limit(k)


def sample_n(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by seeded hash of a unique key.

    The cut is a filter on the hash, so a sample of any size needs neither a sort nor a
    limit, both of which would send it through one task.
    """
    cutoff = smallest_hash_cutoffs(rows, key, seed, F.lit(n)).scalar()
    return rows.filter(seeded_hash(key, seed) <= cutoff)


def _hex_edge(fraction: float) -> str | None:
    # Hash prefixes below the edge belong to the fraction; None stands for "all of them".
    edge = round(fraction * 2**32)
    return None if edge >= 2**32 else f"{edge:08x}"


def in_fraction(key: str, fraction: float, seed: int) -> Column:
    """Row-local test for membership in a reproducible fraction of the rows."""
    edge = _hex_edge(fraction)
    if edge is None:
        return F.lit(True)
    return F.substring(seeded_hash(key, seed), 1, 8) < edge


def sample_fraction(rows: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    return rows.filter(in_fraction(key, fraction, seed))


def train_test_split(rows: DataFrame, fractions: dict[str, float], seed: int, key: str) -> DataFrame:
    """Add a ``split`` column; sizes follow ``fractions`` approximately and nothing is shuffled.

    A second split of one part (for example 5 % first, then 47.37 % of the rest) is this
    function again with another seed.
    """
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("fractions must add up to 1")
    prefix = F.substring(seeded_hash(key, seed), 1, 8)
    split, upto = None, 0.0
    names = list(fractions)
    for name in names[:-1]:
        upto += fractions[name]
        edge = _hex_edge(upto)
        test = F.lit(True) if edge is None else prefix < edge
        split = F.when(test, name) if split is None else split.when(test, name)
    last = F.lit(names[-1])
    return rows.withColumn("split", last if split is None else split.otherwise(last))


def stratified_split(
    rows: DataFrame, strata: Sequence[str], test_size: float, seed: int, key: str
) -> DataFrame:
    """Add ``split`` with ``round(test_size * n)`` test rows in each stratum (half rounds up).

    The wide rows meet only one cut-off per stratum; they are neither sorted nor ranked, so
    the size of a stratum does not matter. ``key`` has to be unique.
    """
    take = F.floor(F.lit(test_size) * F.col("size") + F.lit(0.5))
    cutoffs = materialize(smallest_hash_cutoffs(rows, key, seed, take, by=list(strata)))
    in_test = F.coalesce(seeded_hash(key, seed) <= F.col("_cutoff"), F.lit(False))
    return (
        join_null_safe(rows, cutoffs, list(strata), "left")
        .withColumn("split", F.when(in_test, "test").otherwise("train"))
        .drop("_cutoff")
    )


def split_report(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """Per split and group: rows, percentage of true flags, and share of the split. One pass."""
    true = F.sum(F.col(flag).cast("int")) * F.lit(100.0)
    groups = rows.groupBy("split", by).agg(
        F.count("*").alias("n"), F.try_divide(true, F.count(flag)).alias("percent_true")
    )
    # Written once, the report's few rows are not counted again for the totals.
    groups = materialize(groups)
    totals = groups.groupBy("split").agg(F.sum("n").alias("_total"))
    share = F.col("n") * F.lit(100.0) / F.col("_total")
    return join_null_safe(groups, totals, ["split"]).withColumn("percent_of_split", share).drop("_total")
