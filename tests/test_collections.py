"""Collections laid out by key range, and joins behind a Bloom filter."""

import os
import re

import pytest
from pyspark.sql import functions as F

from curate.operators import joins
from curate.session import fresh_path
from curate.sources import collection


def files(path):
    return {f"{d.removeprefix(path)}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_ranges" not in d}


def state(spark, path):
    return sorted(tuple(r) for r in collection.read_collection(spark, path).select("id", "v").collect())


@pytest.fixture
def numbers(spark):
    path = fresh_path(spark, "collection")
    collection.write_collection(spark.range(0, 4000, 2).select("id", F.lit("old").alias("v")), path, "id", 100)
    return path


def test_a_batch_rewrites_only_its_ranges(spark, numbers):
    before = files(numbers)
    assert len(before) == 20
    batch = spark.range(1000, 1040).select("id", F.lit("new").alias("v"), F.lit(1).alias("version"))
    touched = collection.upsert_collection(spark, numbers, batch, "id", "version")
    after = files(numbers)
    assert len(touched) <= 2 and len(before - after) == len(after - before) == len(touched)
    want = sorted({i: "old" for i in range(0, 4000, 2)} | {i: "new" for i in range(1000, 1040)}).__len__()
    assert len(state(spark, numbers)) == want and (1001, "new") in state(spark, numbers)
    again = state(spark, numbers)
    collection.upsert_collection(spark, numbers, batch, "id", "version")
    assert state(spark, numbers) == again
    assert collection.upsert_collection(spark, numbers, batch.limit(0), "id", "version") == []


def test_keys_outside_all_ranges_and_splits(spark, numbers):
    batch = spark.range(-50, 9000).filter("id < 0 OR id >= 4000").select("id", F.lit("far").alias("v"), F.lit(1).alias("version"))
    touched = collection.upsert_collection(spark, numbers, batch, "id", "version")
    assert len(touched) == 2
    before = state(spark, numbers)
    assert collection.split_ranges(spark, numbers, "id", 100) > 40
    assert state(spark, numbers) == before
    assert collection.split_ranges(spark, numbers, "id", 100) == 0
    assert collection.read_collection(spark, numbers).groupBy(collection.RANGE).count().agg(F.max("count")).first()[0] <= 200
    touched = collection.upsert_collection(spark, numbers, spark.sql("SELECT 8000L AS id, 'x' AS v, 1 AS version"), "id", "version")
    assert len(touched) == 1 and (8000, "x") in state(spark, numbers)


def test_pages_read_one_range(spark, numbers):
    page = collection.collection_page(spark, numbers, "id", 10, after=1099, without=("v",))
    assert [r.id for r in page.collect()] == list(range(1100, 1120, 2)) and page.columns == ["id"]
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"key_range#\d+ = (\d+)", plan))) == 1
    seen, after = [], None
    while rows := collection.collection_page(spark, numbers, "id", 333, after).collect():
        seen += [r.id for r in rows]
        after = seen[-1]
    assert seen == list(range(0, 4000, 2))


def test_text_keys(spark):
    path = fresh_path(spark, "collection")
    keys = [f"k{i:03}é" for i in range(50)]
    collection.write_collection(spark.createDataFrame([(k, 1) for k in keys], "id string, v int"), path, "id", 10)
    collection.upsert_collection(spark, path, spark.createDataFrame([("k0035", 2, 1), ("zzz", 3, 1), ("a", 4, 1)], "id string, v int, version int"), "id", "version")
    assert [r.id for r in collection.collection_page(spark, path, "id", 100).collect()] == sorted([*keys, "k0035", "zzz", "a"])


def test_many_ids(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"), F.repeat(F.lit("x"), 50).alias("wide"), F.lit("b").alias("block"))
    ids = spark.range(0, 20_000, 7).select(F.col("id").alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k"))
    for limit in (joins.FILTER_BYTES, 0):
        semi, anti = joins.semi_by_many_ids(rows, ids, "k", limit), joins.anti_by_many_ids(rows, ids, "k", limit)
        assert semi.columns == anti.columns == rows.columns
        assert sorted(r.k for r in semi.collect()) == [k for k in range(5000) if k % 50 and k % 7 == 0]
        left = [r.k for r in anti.collect()]
        assert sorted(k for k in left if k is not None) == [k for k in range(5000) if k % 50 and k % 7] and left.count(None) == 100
    none = ids.limit(0)
    assert joins.semi_by_many_ids(rows, none, "k").collect() == [] and joins.anti_by_many_ids(rows, none, "k").count() == 5000
    text = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in joins.semi_by_many_ids(text, text.filter("k = 'a'"), "k").collect()] == ["a"]


def test_few_rows_pass_the_filter_and_only_they_are_shuffled(spark):
    rows = spark.range(200_000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 50).alias("wide"))
    ids = spark.range(0, 200_000, 100).select(F.col("id").alias("k"))
    passed = joins.maybe_in(rows, "k", joins.bloom_filter(ids, "k")).filter("_maybe").count()
    assert 2000 <= passed < 2000 + 0.03 * 198_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with ids too many to broadcast
    try:
        plan = joins.semi_by_many_ids(rows, ids, "k")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi, outer = plan.index("LeftSemi"), plan.index("LeftOuter")
    assert semi < plan.index("shiftright") < outer  # the test stands below the join that shuffles, above the one with the filter
