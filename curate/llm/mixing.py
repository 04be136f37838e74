"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash. A source whose target is ``r`` whole passes plus a rest takes each document ``r``
times, and once more those whose hash lies below a threshold that uses up the rest. The threshold comes from
nested histograms: words per (source, leading hash digits), then, inside the one bucket where the budget ends,
per next digits, until the last boundary bucket is settled document by document. Nothing is sorted but that
last bucket, about one row in 16 million of a source.

Shuffled rows are sums per source and bucket with map-side combination, so a source with a third of all rows
costs as much as any other. Targets are computed by windows over one row per source.

Defined results: null texts have size 0; null sources are a source of their own, ordered last; a null id
hashes as the text "null"; rows that repeat an id are separate documents that share a hash and enter in
order of size; empty texts take nothing; sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.llm.frames import NO_ID, arrays_of, id_out, plain, release_memory, table
from curate.llm.words import Words, chunks, spaces

#: Hexadecimal digits of each level of the histogram.
DIGITS = 3
#: Most often that a document is taken.
PASSES = 3


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key`` of every row: size in words, key the md5 of the id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = spaces()
        for batch in batches:
            found = [Words(data, offsets, None, gap).count for _, _, data, offsets in chunks(batch["text"])]
            yield arrays_of(doc_id=batch["doc_id"], source=batch["source"], size=np.concatenate(found) if found else np.empty(0, np.int64))
            release_memory()

    named = plain(docs, F.col("source").cast("string").alias("source"))
    counted = named.mapInArrow(count, "doc_id long, source string, size long")
    return counted.withColumn("key", F.md5(F.coalesce(id_out().cast("string"), F.lit("null"))))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: shares of the total by weight, capped.

    With sources in order of cap per weight, those capped come first: source k is capped if its cap is
    below its share of what the sources before it leave; the first that is not sets the level of the rest. One row per source passes through the windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.row_number().over(order) - 1) % len(weights)).cast("int")]
    rows = sources.withColumn("weight", weight).withColumn("cap", PASSES * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``doc_id, source, size, source_size, target, passes, extra, taken`` of every row.

    ``taken = passes * size + extra`` words. The rest beyond whole passes goes to documents in order of hash;
    the one on the threshold is taken in part (its first ``extra`` words), so that a source meets its target.
    """
    rows, plan = _planned(docs, weights)
    bounds = plan.withColumnsRenamed({"source": "_source"})
    joined = rows.join(bounds, _same(F.col("source"), F.col("_source"))).drop("_source")
    head = F.substring("key", 1, 2 * DIGITS)
    outside = joined.filter(head != F.col("bound")).withColumn("extra", F.when(head < F.col("bound"), F.col("size")).otherwise(0))
    out = outside.unionByName(_on_edge(joined)).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    return out.select(id_out(), "source", "size", "source_size", "target", "passes", "extra", "taken")


def _on_edge(joined: DataFrame) -> DataFrame:
    """The rows in the last boundary buckets, with the words that the rest still pays for."""
    running = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    room = F.floor(F.col("rest") - (F.sum("size").over(running) - F.col("size"))).cast("long")
    edge = joined.filter(F.substring("key", 1, 2 * DIGITS) == F.col("bound"))
    return edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), room)))


def _planned(docs: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, and per source its target, whole passes, rest and boundary bucket (both written)."""
    rows = table(sizes(docs))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets(totals, weights).withColumn("passes", passes)
    plan = table(plan.withColumns({"rest": F.col("target") - F.col("passes") * F.col("source_size"), "bound": F.lit("")}))
    for level in range(2):
        plan = table(_refine(rows, plan, (level + 1) * DIGITS))
    return rows, plan


def _refine(rows: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """Extend each source's boundary by ``DIGITS`` digits: the bucket in which its rest runs out."""
    spec = plan.withColumnsRenamed({"source": "_source"})
    inside = rows.join(spec, _same(F.col("source"), F.col("_source")) & F.col("key").startswith(F.col("bound")))
    bins = inside.groupBy("source", F.substring("key", 1, digits).alias("bin")).agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("source_size", "target", "passes", "rest")]
    )
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("used", F.sum("words").over(running))
    # The first bucket that the rest can't pay for; past them all if it pays for every one.
    short = F.col("used") > F.col("rest")
    found = bins.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "passes")],
        F.coalesce(F.min(F.when(short, F.col("bin"))), F.lit("g")).alias("bound"),
        F.first("rest").alias("budget"),
        F.coalesce(F.max(F.when(~short, F.col("used"))), F.lit(0)).alias("spent"),
    )
    found = found.select("source", "source_size", "target", "passes", (F.col("budget") - F.col("spent")).alias("rest"), "bound")
    kept = plan.withColumnsRenamed({c: f"_{c}" for c in plan.columns})
    merged = kept.join(found, _same(F.col("_source"), F.col("source")), "left")
    return merged.select(
        F.col("_source").alias("source"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_passes").alias("passes"), F.coalesce("rest", "_rest").alias("rest"), F.coalesce("bound", "_bound").alias("bound"),
    )


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed rows of ``docs``, all columns: documents not taken go, others are there once per copy.

    Texts stay whole: the document on a threshold gets its further copy if at least half of it is taken.
    Rows that repeat an id within a source share the larger number of copies. Copies follow from the hash
    of the id and the bounds of its source, a table of one row per source; texts are not shuffled.
    """
    rows, plan = _planned(docs, weights)
    bounds = plan.select(F.col("source").alias("_source"), F.col("passes").alias("_passes"), F.col("rest").alias("_rest"), F.col("bound").alias("_bound"))
    joined = rows.join(plan.withColumnRenamed("source", "_source"), _same(F.col("source"), F.col("_source"))).drop("_source")
    half = (F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size"))
    edge = _on_edge(joined).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from")).agg(F.max(half).alias("_half"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")))
    names = {"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")), "_head": F.substring(key, 1, 2 * DIGITS)}
    names |= {"_own": F.col("source").cast("string"), "row": F.struct("*")}  # no name of a column can clash
    told = docs.select(*[c.alias(n) for n, c in names.items()]).join(bounds, _same(F.col("_own"), F.col("_source")))
    told = told.join(table(edge), (F.col("_doc") == F.col("_id")) & _same(F.col("_own"), F.col("_from")), "left")
    more = (F.col("_head") < F.col("_bound")) | ((F.col("_head") == F.col("_bound")) & F.coalesce("_half", F.lit(False)))
    told = told.withColumn("_copies", F.col("_passes") + more.cast("long")).filter("_copies > 0")
    return told.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")
