"""A keyed collection of records: upsert, paging, summary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.operators.stats import drop_duplicates
from curate.session import materialize


def latest_by_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version per key."""
    return drop_duplicates(rows, [key], [version], keep="last")


def upsert_by_key(target: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """The target with a batch written over it: rows of the batch replace those with the same key.

    Within the batch the highest ``version`` wins; that column belongs to the batch only.
    The target is neither sorted nor grouped: its rows only meet the keys of the batch.
    """
    newest = latest_by_key(batch, key, version).select(*target.columns)
    untouched = target.join(newest.select(key), key, "left_anti")
    return untouched.select(*target.columns).unionByName(newest)


def scroll_page(
    rows: DataFrame, key: str, limit: int, after: object | None = None, without: tuple[str, ...] = ()
) -> DataFrame:
    """The next ``limit`` records after a key, optionally without some columns (the vector)."""
    if after is not None:
        rows = rows.filter(F.col(key) > F.lit(after))
    return rows.drop(*without).orderBy(key).limit(limit)


def collection_info(rows: DataFrame, vector: str) -> DataFrame:
    """Number of records and range of vector lengths."""
    return rows.agg(
        F.count("*").alias("vectors"),
        F.min(F.size(vector)).alias("min_dim"),
        F.max(F.size(vector)).alias("max_dim"),
    )


#: Rows of a key range, and the column (a folder per value) that names it.
RANGE_ROWS, RANGE = 1_000_000, "key_range"


def _ranges(spark: SparkSession, path: str) -> pa.Table:
    """Number and least key of each range, in key order; one row per range."""
    listed = spark.read.parquet(f"{path}/_ranges")
    last = listed.agg(F.max("version")).first()[0]
    return listed.filter(F.col("version") == last).orderBy("least").select("range", "least", "version").toArrow()


def _put_ranges(spark: SparkSession, path: str, rows: DataFrame, version: int) -> None:
    """A version of the list of ranges; readers take the latest, so a change of ranges shows at once or not at all."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/_ranges/version={version}")


def _range_of(key: Column, ranges: pa.Table) -> Column:
    """The range that a key belongs to: the last whose least key is not above it."""
    least, number = ranges["least"].to_numpy(), ranges["range"].to_numpy()

    def place(keys: pa.Array) -> pa.Array:
        at = np.searchsorted(least, keys.to_numpy(zero_copy_only=False), "right") - 1
        return pa.array(number[np.maximum(at, 0)].astype(np.int32))

    place.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "int")(key)


def write_collection(rows: DataFrame, path: str, key: str, rows_per_range: int = RANGE_ROWS) -> None:
    """Write records (keys unique, not null) in folders by range of the key, each sorted by it."""
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // rows_per_range))
    placed = rows.repartitionByRange(n, key).withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, key)
    placed.write.partitionBy(RANGE).parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    _put_ranges(spark, path, written.groupBy(F.col(RANGE).alias("range")).agg(F.min(key).alias("least")), 0)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """All records of a collection, with the range of each."""
    return spark.read.parquet(path).filter(F.col(RANGE).isin(_ranges(spark, path)["range"].to_pylist()))


def upsert_collection(spark: SparkSession, path: str, batch: DataFrame, key: str, version: str) -> list[int]:
    """Write a batch over a collection; returns the ranges that were rewritten.

    Only folders of ranges with a key of the batch are read and replaced; all others keep their files. Within the batch the highest
    ``version`` wins, as in ``upsert_by_key``; a repeated batch changes nothing.
    """
    ranges = _ranges(spark, path)
    placed = materialize(batch.withColumn(RANGE, _range_of(F.col(key), ranges)))
    touched = sorted(r[0] for r in placed.select(RANGE).distinct().collect())  # numbers of ranges
    if touched:
        merged = upsert_by_key(spark.read.parquet(path).filter(F.col(RANGE).isin(touched)), placed, key, version)
        dealt = merged.repartition(RANGE).sortWithinPartitions(RANGE, key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path)
    return touched


def split_ranges(spark: SparkSession, path: str, key: str, rows_per_range: int = RANGE_ROWS) -> int:
    """Split ranges that have grown to more than twice ``rows_per_range`` rows; returns how many new ones there are.

    New ranges are written first, then the list of ranges, then the old folders go; a run that breaks off leaves folders that no reader lists.
    """
    ranges = _ranges(spark, path)
    version, numbers = ranges["version"][0].as_py(), ranges["range"].to_pylist()
    sizes = read_collection(spark, path).groupBy(RANGE).count().filter(F.col("count") > 2 * rows_per_range).collect()
    used, new = spark.read.parquet(path).agg(F.max(RANGE)).first()[0], 0
    for size in sizes:  # one job for each range that is too large
        n = -(-size["count"] // rows_per_range)
        rows = spark.read.parquet(path).filter(F.col(RANGE) == size[RANGE]).drop(RANGE)
        placed = rows.repartitionByRange(n, key).withColumn(RANGE, F.spark_partition_id() + F.lit(used + 1 + new))
        placed.sortWithinPartitions(RANGE, key).write.mode("append").partitionBy(RANGE).parquet(path)
        new += n
    if new:
        old = [s[RANGE] for s in sizes]
        kept = [n for n in numbers if n not in old] + list(range(used + 1, used + 1 + new))
        least = spark.read.parquet(path).filter(F.col(RANGE).isin(kept)).groupBy(F.col(RANGE).alias("range")).agg(F.min(key).alias("least"))
        _put_ranges(spark, path, least, version + 1)
        for n in old:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RANGE}={n}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return new


def collection_page(spark: SparkSession, path: str, key: str, limit: int, after: object | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """The next ``limit`` records after a key, read from the range of that key and as many more as it takes."""
    ranges = _ranges(spark, path)
    least, numbers = ranges["least"].to_pylist(), ranges["range"].to_pylist()
    at = 0 if after is None else max(0, sum(x <= after for x in least) - 1)
    page, missing = None, limit
    while missing > 0 and at < len(numbers):
        part = spark.read.parquet(path).filter(F.col(RANGE) == numbers[at]).drop(RANGE)
        here = scroll_page(part, key, missing, after, without)
        page = here if page is None else page.unionByName(here)
        missing -= here.select(key).count()
        at += 1
    return page.orderBy(key)
