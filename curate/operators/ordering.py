"""Work along a global order without ever putting one order into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.session import as_column, join_null_safe, materialize


def running_totals(
    rows: DataFrame, order: Sequence[str | Column], sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``run_<c>`` (inclusive running total) and ``all_<c>`` (group total) for each column of ``sums``.

    Rows are range-partitioned on group and order, so that even one group that holds
    most rows is spread over many tasks. Only one sum per group and range goes through
    the small window that turns range sums into offsets. ``order`` has to be unique
    within a group: aggregate by it first.
    """
    by = list(by)
    keys = [as_column(c) for c in order]
    placed = rows.repartitionByRange(*[F.col(b) for b in by], *keys)
    # The sampled range bounds differ between runs of the same plan: written down, they are fixed.
    placed = materialize(placed.withColumn("_range", F.spark_partition_id()))

    ranges = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_null_safe(placed, offsets, [*by, "_range"])
    for c in sums:
        joined = joined.withColumn(f"run_{c}", F.sum(c).over(inside) + F.col(f"_before_{c}"))
    return joined.drop("_range", *[f"_before_{c}" for c in sums])


def row_index(rows: DataFrame, order: Sequence[str | Column], start: int = 1, name: str = "row_index") -> DataFrame:
    """Dense numbers from ``start`` along ``order``: one range shuffle and one count per range."""
    keys = [as_column(c) for c in order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The generated id is (partition << 33) + position, i.e. the range and the place in it.
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Written down, the offsets (one row per range) have a known size: the wide rows stay in place.
    offsets = materialize(counts.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")))
    position = F.col("_place") - F.shiftleft("_range", 33)
    return (
        placed.join(F.broadcast(offsets), "_range")  # one row per range, of which there are as many as partitions
        .withColumn(name, F.col("_before") + position + F.lit(start).cast("long"))
        .drop("_place", "_range", "_before")
    )


# Error of the sketch that brackets a quantile, and the group size below which it is not worth one.
SKETCH_ACCURACY = 2_000
SMALL_GROUP = 10_000


def brackets(value: str | Column, probabilities: dict[str, float]) -> Column:
    """Aggregate of a column: the number of its values and two values around each quantile, as a struct."""
    value = as_column(value)
    margin = 2.0 / SKETCH_ACCURACY
    edges = [e for p in sorted(probabilities.values()) for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = F.percentile_approx(value, edges, SKETCH_ACCURACY)
    small = F.count(value) <= SMALL_GROUP
    ends = [F.count(value).alias("_count")]
    for i in range(len(probabilities)):
        ends.append(F.when(small, F.min(value)).otherwise(F.get(sketch, F.lit(2 * i))).alias(f"_low{i}"))
        ends.append(F.when(small, F.max(value)).otherwise(F.get(sketch, F.lit(2 * i + 1))).alias(f"_high{i}"))
    return F.struct(*ends)


def exact_quantiles(
    rows: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probabilities``.

    A first pass sketches each group and brackets every quantile between two values; aggregates in
    ``extra`` are taken in the same pass. A second pass counts what lies below a bracket and the
    distinct values inside it, about 1/500 of a large group; only those are ranked. Small groups (up
    to ``SMALL_GROUP`` values) keep the count of every distinct value, which one aggregation of bounded
    size settles. No task holds all values of a large group, as the built-in exact percentile does.
    """
    by = list(by)
    # A written table has a known size: if it is small it is broadcast and the rows stay put.
    groups = materialize(rows.groupBy(*by).agg(brackets(value, probabilities).alias("_b"), *extra))
    present = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    found = quantiles_in(present, groups.select(*by, "_b"), probabilities, by)
    plain = groups.drop("_b")
    if by:
        return join_null_safe(plain, found, by, "left") if extra else found
    row = found.select(F.struct(*probabilities)).scalar()
    return plain.withColumn("_q", row).select(*plain.columns, "_q.*")


def quantiles_in(present: DataFrame, groups: DataFrame, probabilities: dict[str, float], by: Sequence[str]) -> DataFrame:
    """Second pass: the quantiles of ``_v`` per group, from the groups' brackets ``_b`` (a written table)."""
    names = sorted(probabilities, key=probabilities.get)
    places = [float(probabilities[n]) for n in names]
    if by:
        met = join_null_safe(present, groups.select(*by, "_b.*"), by)
    else:
        met = present.withColumn("_b", groups.select("_b").scalar()).select("_v", "_b.*")

    # Values between brackets collapse into a null per gap. Gaps and brackets are numbered alike,
    # and null sorts before the values of the bracket that ends its gap.
    v, span = F.col("_v"), range(len(names))
    inside = reduce(lambda a, b: a | b, [v.between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in span])
    segment = sum(((v > F.col(f"_high{i}")).cast("int") for i in span), F.lit(0))
    small = F.col("_count") <= SMALL_GROUP
    counts = met.groupBy(*by, small.alias("_small"), segment.alias("_segment"), F.when(inside, v).alias("_v")).agg(F.count("*").alias("n"))
    if by:
        counts = materialize(counts)  # read by both ways below
        few = counts.filter("_small").groupBy(*by).agg(F.percentile("_v", places, F.col("n")).alias("_q"))
        few = few.select(*by, *[F.get("_q", F.lit(names.index(n))).cast("double").alias(n) for n in probabilities])
        counts = counts.filter("NOT _small")
    ranked = running_totals(counts, ["_segment", "_v"], ["n"], by)

    def at(rank: Column) -> Column:
        here = (F.col("run_n") > rank) & (F.col("run_n") - F.col("n") <= rank)
        found = F.max(F.when(here, v.cast("double")))
        missed = F.max("n").isNotNull() & found.isNull()
        return F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(found)

    found = []
    for name, p in zip(names, places):
        place = F.lit(p) * (F.col("all_n") - 1)
        found.append(at(F.floor(place)).alias(f"_lo_{name}"))
        found.append(at(F.ceil(place)).alias(f"_hi_{name}"))
        found.append(F.max(place - F.floor(place)).alias(f"_part_{name}"))
    many = ranked.groupBy(*by).agg(*found).select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in probabilities
        ],
    )
    return many.unionByName(few) if by else many


def seeded_hash(key: str | Column, seed: int) -> Column:
    """Reproducible pseudo-random order: md5 of seed and key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_column(key).cast("string")))


def smallest_hash_cutoffs(
    rows: DataFrame, key: str, seed: int, take: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Per group the hash up to which exactly ``take`` rows lie; ``take`` may use ``size``.

    Counts per 16-bit hash prefix locate the prefix that holds the cut; only its rows
    (1/65536 of a group, however large the group) are ranked. Keys have to be unique; null keys
    are never taken.
    """
    by = list(by)
    hashed = rows.filter(as_column(key).isNotNull()).select(*by, seeded_hash(key, seed).alias("_hash"))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, 4))
    prefixes = hashed.groupBy(*by, "_prefix").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        prefixes.withColumn("_run", F.sum("_n").over(upto))
        .withColumn("size", F.sum("_n").over(group))
        .withColumn("_take", F.least(take.cast("long"), F.col("size")))
        .where((F.col("_run") >= F.col("_take")) & (F.col("_run") - F.col("_n") < F.col("_take")))
        .select(*by, "_prefix", (F.col("_take") - F.col("_run") + F.col("_n")).alias("_need"))
    )
    # Written down, the edges have a known size: unless the groups are very many they are
    # broadcast, and no row outside the edges is shuffled.
    close = join_null_safe(hashed, materialize(edges), [*by, "_prefix"])
    ranked = close.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash")))
    return ranked.where(F.col("_rank") == F.col("_need")).select(*by, F.col("_hash").alias("_cutoff"))
