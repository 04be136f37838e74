"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash.

Only small rows (id, length, prefix hash) are grouped at first. Whole texts are read and hashed for the
documents that still share both with another one; each of those groups is settled by (length, SHA-256).
All grouping is by aggregation with map-side combination, so a text that a third of all rows carry costs
one row per task. Which texts to read is told to the scan by a bitmap of ids of fixed size; texts are not
shuffled, and rows are dropped the same way: only rows that may be concerned meet the list of ids.

Defined results: null texts count as empty; a null id is smaller than any id; rows that repeat both id and
text are one document (``group_size`` counts its rows, ``n_rows`` how often it is there); other columns
are carried by ``drop_exact`` and ignored otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import bitmap_of, id_in, id_out, maybe_in, plain, table

#: Characters that the prefix hash covers.
PREFIX = 64


def keyed(rows: DataFrame) -> DataFrame:
    """Id, length and prefix hash beside the text."""
    return rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "prefix": F.xxhash64(F.substring("text", 1, PREFIX))})


def exact_groups(docs: DataFrame) -> DataFrame:
    """Of equal texts the largest id stays: one row per distinct (id, text).

    ``doc_id, n_bytes, prefix, digest, n_rows, keep_id, group_size, kept``; ``digest`` is the SHA-256 where
    the text had to be read whole, null where length and prefix already told it from all others.
    """
    rows = keyed(plain(docs))
    light = table(rows.select("doc_id", "n_bytes", "prefix"))
    by_length = light.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes")
    same_length = light.join(by_length, "n_bytes", "left_semi")
    by_prefix = same_length.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes", "prefix")
    open_ids = table(same_length.join(by_prefix, ["n_bytes", "prefix"], "left_semi").select("doc_id").distinct())
    read = maybe_in(rows, bitmap_of(open_ids)).filter("_maybe").select("doc_id", "n_bytes", "prefix", F.sha2("text", 256).alias("digest"))
    full = table(
        read.join(open_ids, "doc_id")
        .groupBy("doc_id", "n_bytes", "prefix", "digest")
        .agg(F.count("*").alias("n_rows"))
    )
    groups = full.groupBy("n_bytes", "digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    refined = full.join(groups, ["n_bytes", "digest"])
    one = F.lit(1).cast("long")
    single = light.join(open_ids, "doc_id", "left_anti").withColumns(
        {"digest": F.lit(None).cast("string"), "n_rows": one, "keep_id": F.col("doc_id"), "group_size": one}
    )
    kept = (F.col("doc_id") == F.col("keep_id")).alias("kept")
    return single.unionByName(refined).select(
        id_out(), "n_bytes", "prefix", "digest", "n_rows", id_out("keep_id"), "group_size", kept
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text no larger id repeats; one of the rows that repeat id and text."""
    groups = table(exact_groups(docs).filter("digest is not null").select(id_in().alias("id"), F.col("digest").alias("of"), "n_rows", "kept"))
    key = ["id", "of"]
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.select(F.struct("*").alias("row"), id_in().alias("id"), digest.alias("of"))  # no name of a column can clash
    concerned = groups.filter("not kept or n_rows > 1")
    told = maybe_in(rows, bitmap_of(concerned, "id"), "id")
    left = told.filter("_maybe").join(groups.filter("not kept").select(*key), key, "left_anti")
    again = groups.filter("kept and n_rows > 1").select(*key)
    once = left.join(again, key, "left_anti")
    twice = left.join(again, key, "left_semi").dropDuplicates(key)
    return told.filter("not _maybe").select("row.*").unionByName(once.select("row.*")).unionByName(twice.select("row.*"))
