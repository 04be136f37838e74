"""Frequent pairs of long lists: pairs are first counted by hash bucket, and only what can be frequent is counted itself.

A pair that occurs ``support`` times lies in a bucket with at least that count, and both of its items occur that often. Tasks add up
their buckets in one array, so the first pass shuffles one row per bucket and task; the second forms pairs of frequent items in frequent
buckets only, and adds them up per batch before the shuffle. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.session import materialize

#: Buckets of pairs (a bitmap of 128 KB), and pairs formed at a time.
BUCKETS, PAIRS = 1 << 20, 1 << 20
#: Pairs of distinct items of a batch that are counted in an array (32 MB); more are sorted.
CELLS = 1 << 22


def _bucket(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash bucket of pairs of hashed items."""
    x = low * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def _pairs(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of both items of every pair within a list, about ``PAIRS`` at a time."""
    size = np.diff(edges)
    after = np.repeat(edges[1:], size) - np.arange(edges[-1]) - 1
    upto = np.concatenate([[0], np.cumsum(after)])
    first = 0
    while first < len(after):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, "right")) - 1)
        width = after[first:last]
        left = np.repeat(np.arange(first, last), width)
        yield left, left + 1 + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        first = last


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.cumsum(np.array([len(x) for x in lists], np.int64))])
    return lists.flatten(), edges


def bucket_counts(hashed: DataFrame) -> DataFrame:
    """``bucket, n``: pairs of each list of hashes ``h`` by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flat, edges = _flat(batch["h"])
            flat = flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for left, right in _pairs(edges):
                counts += np.bincount(_bucket(np.minimum(flat[left], flat[right]), np.maximum(flat[left], flat[right])), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    return hashed.select("h").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def frequent_pairs(rows: DataFrame, items: str, support: int) -> DataFrame:
    """Unordered pairs of different items that at least ``support`` lists share: ``item_1, item_2, n`` (``item_1 < item_2``).

    Repeats within a list count once, null items and lists are left out.
    """
    sets = rows.select(F.array_distinct(F.array_compact(F.col(items))).alias("s")).filter(F.size("s") > 0)
    single = sets.select(F.explode("s").alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    often = materialize(single.select("item", F.xxhash64("item").alias("h")))
    # Lists of their frequent items, with the hash of each.
    numbered = sets.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("s").alias("item"))
    kept = materialize(numbered.join(often, "item").groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("s")).filter(F.size("s") > 1))
    hashed = kept.select(F.transform("s", lambda x: F.xxhash64(x)).alias("h"), "s")
    bits = np.zeros(BUCKETS // 8, np.uint8)
    for r in bucket_counts(hashed).filter(F.col("n") >= support).select("bucket").toLocalIterator():  # BUCKETS at most
        bits[r["bucket"] >> 3] |= 1 << (r["bucket"] & 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, edges = _flat(batch["h"])
            hashes = hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            named = batch["s"].flatten().dictionary_encode()
            code, size = named.indices.to_numpy().astype(np.int64), len(named.dictionary)
            counts = np.zeros(size * size, np.int64) if size * size <= CELLS else None
            for left, right in _pairs(edges):
                at = _bucket(np.minimum(hashes[left], hashes[right]), np.maximum(hashes[left], hashes[right]))
                live = (bits[at >> 3] >> (at & 7)) & 1 == 1
                pair = code[left[live]] * size + code[right[live]]
                if counts is not None:
                    counts += np.bincount(pair, minlength=len(counts))
                else:
                    yield from counted(named.dictionary, *np.unique(pair, return_counts=True))
            if counts is not None:
                pair = np.flatnonzero(counts)
                yield from counted(named.dictionary, pair, counts[pair])

    def counted(items: pa.Array, pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(pair):
            yield pa.RecordBatch.from_arrays([*(items.take(pa.array(x)) for x in np.divmod(pair, len(items))), pa.array(n)], ["item_1", "item_2", "n"])

    kind = kept.schema["s"].dataType.elementType.simpleString()
    formed = hashed.mapInArrow(run, f"item_1 {kind}, item_2 {kind}, n long")
    return formed.groupBy("item_1", "item_2").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
