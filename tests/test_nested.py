"""Nested records of model output, generators over groups and frequent pairs."""

import datetime
import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curate.functions import variants
from curate.operators import pairs, sessions


@pytest.mark.parametrize(
    "text, found",
    [
        ('x {"a": {"b": "}"}} y', '{"a": {"b": "}"}}'),
        (r'{"a": "\"}{"}', r'{"a": "\"}{"}'),
        ('{plain} {"a": 1} {"b": 2}', '{"a": 1}'),
        ('{"open": {"a": 1}', '{"a": 1}'),
        ('{"open": {"a": 1}, {"b": 2} {', '{"a": 1}'),
        ("{ } rest", "{ }"),
        ('{"a": "never closed', None),
        ("no object", None),
        ("", None),
        ('}}{"a": [1, {"b": 2}]}', '{"a": [1, {"b": 2}]}'),
        ('```json\n{"a":\n 1}\n```', '{"a":\n 1}'),
    ],
)
def test_balanced_object(text, found):
    assert variants.balanced_object(text) == found


def test_any_record_is_found_in_prose():
    rnd = random.Random(5)

    def value(depth):
        kind = rnd.randrange(6 if depth else 4)
        return [rnd.randint(-9, 9), rnd.choice(['a"b', "}", "{", "\\", "é\n"]), None, True, {rnd.choice('ab{"'): value(depth - 1) for _ in range(rnd.randint(0, 3))} if kind == 4 else 0, [value(depth - 1) for _ in range(2)] if kind == 5 else 1][kind]

    for _ in range(500):
        record = json.dumps({f"k{i}": value(3) for i in range(rnd.randint(0, 4))}, ensure_ascii=rnd.random() < 0.5)
        assert variants.balanced_object(f"as {{asked}}: {record} }} {{") == record


def test_many_open_braces_take_linear_time():
    assert variants.balanced_object('{"a' * 50_000) is None
    assert variants.balanced_object("{" * 50_000 + '{"b": 1}') == '{"b": 1}'


def test_variants(spark):
    rows = spark.createDataFrame([(1, 'say {"a": {"b": [1, 2]}, "c": "x"}'), (2, '{"a": 5}'), (3, "none"), (4, None), (5, '{"a": nope}')], "id int, t string")
    record = rows.select("id", variants.parse_record("t").alias("v"))
    got = {r.id: (r.b, r.broken) for r in record.select("id", variants.field("v", "$.a.b[1]", "int").alias("b"), variants.violations("v", {"$.a": "OBJECT", "$.c": "STRING"}).alias("broken")).collect()}
    every = ["$.a", "$.c"]
    assert got == {1: (2, []), 2: (None, every), 3: (None, every), 4: (None, every), 5: (None, every)}
    schema = variants.inferred_schema(record.filter("id = 1"), "v").first()["schema"]
    assert schema == "OBJECT<a: OBJECT<b: ARRAY<BIGINT>>, c: STRING>"


def plain_sessions(rows, gap, least):
    out = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        run = []
        for t in [*times, None]:
            if run and (t is None or (t - run[-1]).total_seconds() > gap):
                if len(run) >= least:
                    out.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_sessions(spark, batch):
    rnd = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), start + datetime.timedelta(seconds=rnd.randint(0, 20_000))) for _ in range(600)]
    rows += [("a", None), ("single", start)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame(rows, "k string, t timestamp_ntz").repartition(5)
        for least in (1, 3):
            got = sessions.sessions(frame, "k", "t", 60, least).collect()
            assert sorted((tuple(r) for r in got), key=str) == plain_sessions(rows, 60, least)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sessions.sessions(frame.limit(0), "k", "t", 60).collect() == []


@pytest.mark.parametrize("buckets", [1 << 20, 64])
def test_frequent_pairs(spark, rows, buckets, monkeypatch):
    monkeypatch.setattr(pairs, "BUCKETS", buckets)
    monkeypatch.setattr(pairs, "PAIRS", 100)
    rnd = random.Random(4)
    lists = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 25))] for _ in range(120)] + [None, [None, "a", "b"], ["a", "a"]]
    frame = spark.createDataFrame([(x, 1) for x in lists], "l array<string>, h int").repartition(3)
    count = Counter(p for x in lists if x for p in itertools.combinations(sorted({i for i in x if i}), 2))
    assert rows(pairs.frequent_pairs(frame, "l", 12)) == sorted(((a, b, n) for (a, b), n in count.items() if n >= 12), key=repr)
    assert rows(pairs.frequent_pairs(frame, "l", 10**6)) == [] == rows(pairs.frequent_pairs(frame.limit(0), "l", 1))


def test_few_pairs_are_formed(spark):
    # 400 items, of which two go together: nearly all buckets are infrequent.
    lists = [[f"i{(n * 37 + j * j) % 400}" for j in range(20)] + (["x", "y"] if n % 4 == 0 else []) for n in range(400)]
    frame = spark.createDataFrame([(x,) for x in lists], "l array<string>")
    hashed = frame.select(F.transform(F.array_distinct("l"), lambda x: F.xxhash64(x)).alias("h"))
    frequent = pairs.bucket_counts(hashed).filter("n >= 60").agg(F.sum("n")).first()[0]
    every = pairs.bucket_counts(hashed).agg(F.sum("n")).first()[0]
    assert frequent < 0.05 * every
    assert [tuple(r) for r in pairs.frequent_pairs(frame, "l", 60).collect()] == [("x", "y", 100)]


def test_frequent_pairs_are_added_up_per_batch(spark, rows, monkeypatch):
    # 200 equal lists in one batch: a row per pair is shuffled, not one per pair and PAIRS pairs formed.
    monkeypatch.setattr(pairs, "PAIRS", 10)
    frame = spark.createDataFrame([(list("abcdef"),)] * 200, "l array<string>").coalesce(1)
    want = [(a, b, 200) for a, b in itertools.combinations("abcdef", 2)]
    assert rows(pairs.frequent_pairs(frame, "l", 5)) == want
    monkeypatch.setattr(pairs, "CELLS", 35)  # one less than all pairs of six items: sorted instead
    assert rows(pairs.frequent_pairs(frame, "l", 5)) == want
