"""Joins between a corpus and its annotations, ids, predictions and lookup tables.

No join carries a broadcast hint: Spark broadcasts a side only after checking its size
(statically and again at run time) and splits skewed partitions of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.session import materialize

#: A Bloom filter's bits per id and bits set per id (2 % false hits), bits of a block, and the largest filter that is sent to all tasks.
BITS_PER_ID, HASHES, BLOCK_BITS, FILTER_BYTES = 10, 5, 1 << 15, 128 << 20


def join_metadata(rows: DataFrame, metadata: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner equi-join."""
    return rows.join(metadata, on, "inner")


def join_annotations_outer(rows: DataFrame, annotations: DataFrame, on: str) -> DataFrame:
    """Full outer equi-join that keeps unmatched rows of both sides.

    Written as a left join plus the unmatched annotations, because Spark can split a
    skewed key in a left join but not in a full outer one.
    """
    matched = rows.join(annotations, on, "left")
    keys = rows.select(on).distinct()
    unmatched = annotations.join(keys, on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def semi_by_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Keep rows whose id is in ``ids``."""
    return rows.join(ids.select(on), on, "left_semi")


def anti_by_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Keep rows whose id is not in ``ids``, for example those not processed yet."""
    return rows.join(ids.select(on), on, "left_anti")


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _bits(key: str) -> list[Column]:
    """Places of an id's bits within its block."""
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(BLOCK_BITS)).cast("long") for i in range(HASHES)]


def bloom_filter(ids: DataFrame, on: str, filter_bytes: int = FILTER_BYTES) -> DataFrame | None:
    """A Bloom filter of a column in blocks of 4 KB, ``_block, _set``, sized from the number of ids.

    Built by aggregation, so that tasks pass on bits instead of ids. ``None`` if it would be larger than ``filter_bytes``.
    """
    blocks = max(1, -(-ids.agg(F.count(on)).first()[0] * BITS_PER_ID // BLOCK_BITS))
    if blocks * BLOCK_BITS // 8 > filter_bytes:
        return None
    bits = ids.filter(F.col(on).isNotNull()).select(_block(on, blocks).alias("_block"), F.explode(F.array(*_bits(on))).alias("_bit"))
    built = bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_set"))
    return materialize(built.withColumn("_blocks", F.lit(blocks)))


def maybe_in(rows: DataFrame, on: str, built: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``, told in the scan: false where the id is surely not among those of the filter."""
    size = built.select("_blocks").first()
    keys = rows.withColumn("_of", _block(on, size["_blocks"] if size else 1))
    met = keys.join(F.broadcast(built.drop("_blocks")), F.col("_of") == F.col("_block"), "left")  # of checked size

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_set", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1

    hit = F.col(on).isNotNull() & reduce(lambda a, b: a & b, [is_set(b) for b in _bits(on)])
    return met.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_of", "_block", "_set")


def semi_by_many_ids(rows: DataFrame, ids: DataFrame, on: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``semi_by_ids`` for a long list and wide rows: only rows that pass a Bloom filter in the scan are shuffled."""
    built = bloom_filter(ids, on, filter_bytes)
    if built is None:
        return semi_by_ids(rows, ids, on)
    return semi_by_ids(maybe_in(rows, on, built).filter("_maybe").drop("_maybe"), ids, on)


def anti_by_many_ids(rows: DataFrame, ids: DataFrame, on: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``anti_by_ids`` for a long list and wide rows: rows that a Bloom filter clears in the scan stay where they are."""
    built = bloom_filter(ids, on, filter_bytes)
    if built is None:
        return anti_by_ids(rows, ids, on)
    told = maybe_in(rows, on, built)
    kept = anti_by_ids(told.filter("_maybe"), ids, on)
    return told.filter("NOT _maybe").unionByName(kept).drop("_maybe").select(*rows.columns)


def attach_predictions(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Put predictions beside their rows by key; rows without one get nulls."""
    return rows.join(predictions, key, "left")


def lookup_join(rows: DataFrame, table: DataFrame, on: str, table_key: str) -> DataFrame:
    """Map ids through a small table; unknown ids get nulls."""
    table = table.withColumnRenamed(table_key, "_lookup_key")
    return rows.join(table, F.col(on) == F.col("_lookup_key"), "left").drop("_lookup_key")
