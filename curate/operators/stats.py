"""Descriptive statistics, frequencies, cross tables and label agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.operators.ordering import brackets, exact_quantiles, quantiles_in
from curate.session import as_column, join_null_safe, materialize, spread


def digest_of(columns: Sequence[str]) -> Column:
    """A fixed-width key of some columns: SHA-256 over their JSON, which tells null from empty."""
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    return F.unhex(F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _with_share(counts: DataFrame, n: str, name: str, scale: float) -> DataFrame:
    # A scalar subquery over the already grouped counts: Spark reuses their shuffle, and the
    # total is not a window over everything in one task.
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(name, F.col(n) * F.lit(scale) / total)


def group_mean(rows: DataFrame, by: str, value: str | Column, name: str = "mean") -> DataFrame:
    return rows.groupBy(by).agg(F.avg(as_column(value)).alias(name))


def group_count_mean_having(rows: DataFrame, by: str, value: str, more_than: int) -> DataFrame:
    """Non-null count and mean per group, for groups with more than ``more_than`` values."""
    grouped = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return grouped.filter(F.col("n") > more_than)


def group_count(rows: DataFrame, by: str | Sequence[str], name: str = "n") -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def percent_true(rows: DataFrame, by: str, flag: str, name: str = "percent") -> DataFrame:
    """Percentage of rows with a true (or 1) flag; null flags are not counted."""
    share = F.try_divide(F.sum(F.col(flag).cast("int")) * F.lit(100.0), F.count(flag))
    return rows.groupBy(by).agg(share.alias(name), F.count(flag).alias("n"))


def share_of_total(rows: DataFrame, by: str) -> DataFrame:
    """Rows per group and their percentage of all rows."""
    return _with_share(group_count(rows, by), "n", "percent", 100.0)


def value_counts(rows: DataFrame, column: str, normalize: bool = False, top: int | None = None) -> DataFrame:
    """Frequency of each value, optionally its proportion and only the ``top`` most frequent."""
    counts = group_count(rows, column)
    if normalize:
        counts = _with_share(counts, "n", "proportion", 1.0)
    if top is not None:
        counts = counts.orderBy(F.desc("n"), column).limit(top)
    return counts


def topk_by_count(rows: DataFrame, by: str, k: int) -> DataFrame:
    return value_counts(rows, by, top=k)


def _summary(value: str) -> list[Column]:
    return [
        F.count(value).alias("count"),
        (F.count("*") - F.count(value)).alias("null_count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    ]


def describe_by(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, null_count, mean, sample deviation, min, max and exact quartiles per group, in two passes."""
    return exact_quantiles(rows, value, QUARTILES, list(by), extra=_summary(value))


def describe(rows: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One row of summary statistics per numeric column, in two passes over the rows.

    The first takes all columns side by side in one aggregation, and aggregates of ``extra`` with
    them, which are added to each row; only the second, which looks for values around the quartiles,
    turns columns into rows.
    """
    wide = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    sides = [F.struct(F.lit(c).alias("column"), brackets(c, QUARTILES).alias("_b"), *_summary(c)) for c in columns]
    first = wide.agg(F.array(*sides).alias("_sides"), *extra)
    groups = materialize(first.select(F.explode("_sides").alias("_s"), *[c for c in first.columns if c != "_sides"]).select("_s.*", "*").drop("_s"))
    long = wide.select(*columns).unpivot([], list(columns), "column", "_v").filter("_v IS NOT NULL")
    found = quantiles_in(long, groups.select("column", "_b"), QUARTILES, ["column"])
    return groups.drop("_b").join(found, "column", "left").select("column", *[c for c in groups.columns if c not in ("column", "_b")], *QUARTILES)


def n_unique(rows: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; null counts as one value. The estimate ignores nulls.

    Each column is counted apart, by a fixed-width digest, so neither wide values nor copies of the
    rows are shuffled.
    """
    if approximate:
        return rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    counts = {c: rows.select(digest_of([c]).alias("_d")).groupBy("_d").agg(F.lit(1).alias("_one")).agg(F.count("*")) for c in columns}
    one = rows.sparkSession.range(1)
    return one.select(*[count.scalar().alias(c) for c, count in counts.items()])


def distinct_values(rows: DataFrame, column: str | Column, name: str) -> DataFrame:
    return rows.select(as_column(column).alias(name)).distinct()


def drop_duplicates(
    rows: DataFrame, subset: Sequence[str], order: Sequence[str | Column], keep: str = "first"
) -> DataFrame:
    """One row per key: the first (or last) along ``order``.

    The ``= 1`` filter lets Spark keep one candidate per key and task before the shuffle,
    so a key with a third of all rows moves no more data than any other. String keys are
    compared by digest.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    keys = [as_column(c) for c in order]
    if keep == "last":
        keys = [k.desc() for k in keys]
    wide = [c for c in subset if rows.schema[c].dataType.typeName() == "string"]
    narrow = [c for c in subset if c not in wide]
    if wide:
        rows = rows.withColumn("_digest", digest_of(wide))
    window = Window.partitionBy(*narrow, *(["_digest"] if wide else [])).orderBy(*keys)
    return rows.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn", "_digest")


def token_frequencies(
    rows: DataFrame, text: str, key: str, lower: bool = False, top: int | None = None
) -> DataFrame:
    """Token counts over the distinct texts, split on single spaces (empty tokens count).

    ``key`` is unique. Equal texts are found by digest; the tokens of those with the smallest key
    count, so texts are moved only if Spark finds the keys too many to broadcast.
    """
    column = F.lower(text) if lower else F.col(text)
    digests = rows.filter(F.col(text).isNotNull()).select(digest_of([text]).alias("_d"), F.col(key).alias("_key"))
    first = digests.groupBy("_d").agg(F.min("_key").alias(key)).select(key)
    kept = spread(rows.select(key, text)).join(first, key, "left_semi")
    tokens = kept.select(F.explode(F.split(column, " ")).alias("token"))
    return value_counts(tokens, "token", top=top)


#: Values that a summary of frequent values keeps, and its error as a share of all rows: this by their number.
TRACKED, SUMMARY_ERROR = 50_000, 3.5


def heavy_hitters(rows: DataFrame, column: str, k: int, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values (null is one) with exact counts, ties by value: ``column, n``.

    Every task keeps a summary of at most ``tracked`` values or so, and the summaries are merged; a second pass counts only
    the values in it, so no row per distinct value is shuffled. A value that the summary lacks occurs at most ``SUMMARY_ERROR / tracked``
    of all rows, or as often as its last value: if the ``k``-th exact count exceeds that, none is missed. Otherwise,
    as with few or nearly equally frequent values, all are counted.
    """
    items = rows.select(F.col(column).alias("_item"))
    summary = materialize(items.agg(F.expr(f"approx_top_k(_item, {tracked}, {tracked})").alias("_top"), F.count("*").alias("_n")))
    size = summary.select("_n", F.size("_top").alias("kept"), F.coalesce(F.array_min(F.transform("_top", lambda x: x["count"])), F.lit(0)).alias("last")).first()
    missed = max(SUMMARY_ERROR * size["_n"] / tracked, size["last"] if size["kept"] >= tracked else 0)
    candidates = summary.select(F.explode("_top").alias("_c")).select(F.col("_c.item").alias("_candidate"))
    counted = items.join(candidates, F.col("_item").eqNullSafe(F.col("_candidate")), "left_semi").withColumnRenamed("_item", column)
    best = materialize(value_counts(counted, column, top=k))
    least = best.agg(F.count("*").alias("found"), F.min("n").alias("n")).first()
    if least["found"] == k and least["n"] > missed:
        return best
    return value_counts(rows, column, top=k)


def flat_list_frequencies(rows: DataFrame, items: str, name: str = "item") -> DataFrame:
    return value_counts(rows.select(F.explode(items).alias(name)), name)


def count_by_predicate(rows: DataFrame, expression: Column, name: str = "class") -> DataFrame:
    """Rows per class of a computed expression, with the proportion of each."""
    return value_counts(rows.select(expression.alias(name)), name, normalize=True)


def top_categories_filter(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Keep the rows of the ``k`` most frequent non-null values."""
    best = topk_by_count(rows.filter(F.col(column).isNotNull()), column, k).select(column)
    return rows.join(best, column, "left_semi")


def top_within_category(rows: DataFrame, category: str, wanted: str, subject: str, k: int) -> DataFrame:
    """Most frequent subjects of one category, with their percentage within it."""
    counts = group_count(rows.filter(F.col(category) == wanted), subject)
    return _with_share(counts, "n", "percent", 100.0).orderBy(F.desc("n"), subject).limit(k)


def group_members(rows: DataFrame, list_key: str, member: str) -> DataFrame:
    """One row per entry of a list-valued key and member, with the members of the entry.

    A member may appear under several keys; it has to be unique per row.
    """
    pairs = rows.select(F.explode(F.array_distinct(list_key)).alias("key"), F.col(member).alias("member"))
    # The counts are written down so that Spark knows their size and can broadcast them.
    sizes = materialize(pairs.groupBy("key").agg(F.count("*").alias("n_members")))
    return join_null_safe(pairs, sizes, ["key"])


def group_member_lists(rows: DataFrame, list_key: str, member: str, per_row: int) -> DataFrame:
    """Members of each entry of a list-valued key as lists of about ``per_row``, numbered by ``part``.

    A member's part follows the first 32 bits of its md5, so that no list outgrows a task.
    """
    parts = F.ceil(F.col("n_members") / F.lit(per_row))
    place = F.conv(F.substring(F.md5(F.col("member").cast("string")), 1, 8), 16, 10).cast("long")
    placed = group_members(rows, list_key, member).withColumn("part", F.pmod(place, parts))
    return placed.groupBy("key", "part").agg(
        F.max("n_members").alias("n_members"), F.array_sort(F.collect_list("member")).alias("members")
    )


def pivot_counts(rows: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Cross table of counts for the declared ``values``; gaps are 0."""
    named = [str(v) for v in values]
    wide = rows.groupBy(row).agg(
        *[F.count(F.when(F.col(column) == F.lit(v), 1)).alias(n) for v, n in zip(values, named)]
    )
    return wide


def row_percentages(wide: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Each cell as a percentage of its row total; an empty row stays null."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    shares = {c: F.round(F.try_divide(F.col(c) * F.lit(100.0), total), digits) for c in columns}
    return wide.withColumns(shares)


def unpivot_long(wide: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(ids), list(columns), "variable", "value")


def label_combinations(rows: DataFrame, labels: str) -> DataFrame:
    """Distinct sorted label sets with more than one label, and the rows that have them."""
    sets = rows.select(F.array_sort(F.array_distinct(labels)).alias("combination"))
    return group_count(sets.filter(F.size("combination") > 1), "combination")


def label_cooccurrence(rows: DataFrame, labels: str) -> DataFrame:
    """Ordered pairs of different labels on the same row, with their share of all pairs.

    Rows are first counted per label set; pairs are formed once per set, not per row.
    """
    sets = label_combinations(rows, labels)
    pairs = (
        sets.select("combination", "n", F.explode("combination").alias("label_1"))
        .select("n", "label_1", F.explode("combination").alias("label_2"))
        .filter(F.col("label_1") != F.col("label_2"))
    )
    counts = pairs.groupBy("label_1", "label_2").agg(F.sum("n").alias("n"))
    return _with_share(counts, "n", "percent", 100.0)


def top_label_pairs(rows: DataFrame, labels: str, k: int) -> DataFrame:
    """Most frequent unordered pairs of labels given to the same row."""
    pairs = label_cooccurrence(rows, labels).filter(F.col("label_1") < F.col("label_2"))
    return pairs.select("label_1", "label_2", "n").orderBy(F.desc("n"), "label_1", "label_2").limit(k)


def annotator_disagreement(rows: DataFrame, labels: str) -> DataFrame:
    """Rows whose annotators gave more than one distinct label."""
    return rows.filter(F.size(F.array_distinct(labels)) > 1)


def disagreeing_combinations(rows: DataFrame, labels: str) -> DataFrame:
    """Distinct sorted label lists (repeats kept) among the disagreeing rows."""
    return annotator_disagreement(rows, labels).select(F.array_sort(labels).alias(labels)).distinct()


def group_mean_list_len(rows: DataFrame, by: str, items: str, name: str = "mean_len") -> DataFrame:
    size = F.when(F.col(items).isNotNull(), F.size(items))
    return rows.groupBy(by).agg(F.avg(size).alias(name))


def coverage_ratio(rows: DataFrame, column: str) -> DataFrame:
    """Annotated rows, all rows and their ratio."""
    return rows.agg(
        F.count(column).alias("annotated"),
        F.count("*").alias("total"),
        F.try_divide(F.count(column), F.count("*")).alias("ratio"),
    )


def min_max_mean_median(rows: DataFrame, value: str) -> DataFrame:
    """Summary of a score or of the row-wise maximum of an array of scores."""
    if rows.schema[value].dataType.typeName() == "array":
        rows = rows.select(F.array_max(value).alias(value))
    plain = rows.agg(
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        F.avg(value).alias("mean"),
    )
    return plain.withColumn("median", exact_quantiles(rows, value, {"median": 0.5}).scalar())


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram between minimum and maximum; the top edge falls into the last bin."""
    rows = rows.filter(F.col(value).isNotNull())
    ends = rows.agg(
        F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    ).scalar()
    # A single value gets a bin range of width one around it.
    flat = ends.getField("lo") == ends.getField("hi")
    low = F.when(flat, ends.getField("lo") - 0.5).otherwise(ends.getField("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(ends.getField("hi") - ends.getField("lo")) / F.lit(bins)
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    counts = rows.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    edges = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("left_edge"),
        (low + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def largest_key(rows: DataFrame, by: str) -> DataFrame:
    """The most frequent value and its count, ties by value."""
    return topk_by_count(rows.filter(F.col(by).isNotNull()), by, 1)


def counts_above(trials: DataFrame, parameter: str, value: str, cut: float) -> DataFrame:
    """How often each value of a parameter occurs among the trials above a cut, and its share of them."""
    return value_counts(trials.filter(F.col(value) > cut), parameter, normalize=True)


def trial_leaderboard(trials: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The ``k`` best trials by value, ties by key."""
    return trials.orderBy(F.desc(value), key).limit(k)


def best_per_study(trials: DataFrame, study: str, value: str, key: str) -> DataFrame:
    """The best trial of each study, ties by key."""
    return drop_duplicates(trials, [study], [F.desc(value), F.col(key)])


def cheapest_trial(trials: DataFrame, value: str, at_least: float, cost: str, key: str) -> DataFrame:
    """The trial with the lowest cost among those that reach ``at_least``."""
    return trials.filter(F.col(value) >= at_least).orderBy(cost, F.desc(value), key).limit(1)


def cost_estimate(rows: DataFrame, by: str, unit_price: float) -> DataFrame:
    """Items and their price per group at a fixed price per item."""
    return group_count(rows, by, "items").withColumn("cost", F.col("items") * F.lit(unit_price))
