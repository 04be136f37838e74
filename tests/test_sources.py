"""Sources, sinks, collections and streams."""

import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from curate.operators import search
from curate.session import fresh_path, materialize, scratch, shared_dir
from curate.sources import collection, readers, writers
from curate.streaming import state, streams


def test_worker_functions_need_no_installed_package():
    function = cloudpickle.dumps(search.nearest_in_block)
    code = "import pickle, sys; print(pickle.load(sys.stdin.buffer).__name__)"
    done = subprocess.run([sys.executable, "-c", code], input=function, capture_output=True, cwd="/", timeout=60)
    assert done.stdout.strip() == b"nearest_in_block"


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark).startswith(configured.rstrip("/") if configured else "/")


def test_select_files(spark, tmp_path):
    for name in ("data/sco/a.parquet", "data/sco/.b.parquet", "data/sco_removed/c.parquet", "data/dan/d.parquet", "data/sco/e.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = readers.select_files(spark, root, "sco", ".parquet", ["removed"])
        assert [r["file"] for r in found.collect()] == ["data/sco/a.parquet"]


def test_sample_files(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(20)], "path string")
    chosen = readers.sample_files(files, 5, 42)
    assert len(set(chosen)) == 5 and chosen == readers.sample_files(files.repartition(4), 5, 42)


def test_json_export(spark, tmp_path):
    (tmp_path / "export.json").write_text(json.dumps([{"image": "a/b", "choice": "x", "other": 1}, {"image": "c"}], indent=1))
    got = readers.read_json_columns(spark, str(tmp_path), "image string, choice string").collect()
    assert sorted(map(tuple, got)) == [("a/b", "x"), ("c", None)]


def test_bad_lines_do_not_depend_on_the_columns_used(spark, tmp_path):
    lines = ["a\tb\tc", "1\tx\t2", "y\tx\t2", "2\tx", "3\tx\tq", "4\tx\t5\tz", "5\td\t"]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n")
    frame = readers.read_csv_skip_bad(spark, str(tmp_path), "a long, b string, c int")
    assert [tuple(r) for r in frame.collect()] == [(1, "x", 2), (5, "d", None)]
    assert frame.count() == 2 and [r["b"] for r in frame.select("b").collect()] == ["x", "d"]


def test_folder_name(spark):
    frame = spark.createDataFrame([("/x/train/cats/1.jpg",), ("1.jpg",)], "p string")
    assert [r[0] for r in frame.select(readers.folder_name("p", 2)).collect()] == ["cats", None]


def test_partitioned_write_reads_back(spark, rows):
    path = fresh_path(spark, "test-write")
    frame = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}") for i in range(100)], "id int, k string")
    writers.write_parquet(frame, path, ["k"], rebalance=True)
    assert rows(spark.read.parquet(path), "id", "k") == rows(frame, "id", "k")
    labelled = readers.label_from_path(spark.read.parquet(path))
    assert labelled.filter("label <> k").count() == 0


def test_label_from_folder_with_special_characters(spark, tmp_path):
    for folder in ("has space", "a+b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text("t")
    texts = spark.read.text([str(tmp_path / "has space"), str(tmp_path / "a+b")])
    assert sorted(r["label"] for r in readers.label_from_path(texts).collect()) == ["a+b", "has space"]


def test_materialize_cuts_the_lineage(spark):
    frame = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "parquet" in plan and frame.count() == 10


def test_published_versions(spark):
    path = fresh_path(spark, "test-published")
    frame = spark.createDataFrame([(1, True, "train"), (2, False, "test")], "id int, flag boolean, split string")
    writers.publish_dataset(frame.limit(1), path, version="2024-03-01")
    writers.publish_dataset(frame, path, casts={"flag": "int"}, version="2024-11-01")
    latest = writers.read_published(spark, path)
    assert latest.schema["flag"].dataType.simpleString() == "int" and latest.count() == 2
    assert writers.read_published(spark, path, "2024-03-01").count() == 1
    assert writers.published_versions(spark, path).count() == 2
    writers.publish_dataset(frame.limit(1), path, version="2024-11-01")  # again on the same day
    assert writers.read_published(spark, path).count() == 1 and writers.published_versions(spark, path).count() == 2


def test_write_ids_and_csv(spark, rows):
    path = fresh_path(spark, "test-ids")
    frame = spark.createDataFrame([("<urn:1>", "a,b"), ("<urn:2>", 'q"x')], "id string, t string")
    writers.write_ids(frame, "id", path)
    assert rows(spark.read.text(path)) == ["<urn:1>", "<urn:2>"]
    writers.write_csv(frame, path + "-csv")
    assert rows(readers.read_csv_schema(spark, path + "-csv", "id string, t string", header=True)) == rows(frame)


def test_upsert_is_idempotent(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "id int, v string, version int")
    once = collection.upsert_by_key(target, batch, "id", "version")
    assert rows(once) == [(1, "a"), (2, "new"), (3, "c")]
    assert rows(collection.upsert_by_key(once, batch, "id", "version")) == rows(once)


def test_scrolling_visits_every_record_once(spark):
    frame = spark.createDataFrame([(i, [0.0]) for i in range(25)], "id int, v array<double>")
    seen, after = [], None
    while page := collection.scroll_page(frame, "id", 10, after, without=("v",)).collect():
        seen += [r["id"] for r in page]
        after = seen[-1]
    assert seen == list(range(25)) and page == []


def test_stream_upsert_survives_a_repeated_batch(spark, rows):
    source, target = fresh_path(spark, "test-changes"), fresh_path(spark, "test-target")
    frame = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    frame.write.parquet(source)
    stream = streams.stream_corpus(spark, source, frame.schema, max_files=1)
    for checkpoint in ("c1", "c1", "c2"):  # the same checkpoint again, then a lost one
        streams.stream_upsert(stream, target, f"{target}-{checkpoint}").awaitTermination()
    spark.createDataFrame([(2, "c", 2)], frame.schema).write.mode("append").parquet(source)
    streams.stream_upsert(stream, target, f"{target}-c2").awaitTermination()
    assert rows(streams.read_upserted(spark, target, "id", "version")) == [(1, "a", 1), (2, "c", 2)]


def test_latest_changes_over_runs(spark, rows):
    source, out = fresh_path(spark, "test-versions"), fresh_path(spark, "test-latest")
    schema = "k string, version long, v string"

    def run(*data):
        spark.createDataFrame(list(data), schema).write.mode("append").parquet(source)
        stream = streams.stream_corpus(spark, source, spark.createDataFrame([], schema).schema)
        streams.stream_to_parquet(state.latest_changes(stream, "k", "version"), out, f"{out}-c").awaitTermination()
        return rows(spark.read.parquet(out))

    first = run(("a", 1, "x"), ("a", 3, "z"), ("b", 1, "x"), ("a", 2, "y"))
    assert first == [("a", 3, "z", 1), ("b", 1, "x", 1)]
    assert run(("a", 3, "again"), ("a", 2, "late"), ("b", 1, "again")) == first  # nothing new: no output
    assert run(("b", 5, "w"), ("c", 1, "x")) == [*first, ("b", 5, "w", 2), ("c", 1, "x", 1)]


def test_compacted_upserts(spark, rows):
    target, source, state = (fresh_path(spark, f"test-compact-{n}") for n in ("log", "in", "state"))
    schema = "id int, v string, version int"

    def change(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.stream_corpus(spark, source, spark.createDataFrame([], schema).schema, max_files=1)
        streams.stream_upsert(stream, target, f"{target}-checkpoint").awaitTermination()

    change((1, "a", 1), (2, "b", 1))
    assert streams.compact_upserted(spark, target, "id", "version", state) == 0
    change((2, "c", 2), (3, "d", 1))
    want = [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert rows(streams.read_upserted(spark, target, "id", "version", state)) == want
    assert streams.compact_upserted(spark, target, "id", "version", state, before=state) == 1
    assert rows(streams.read_upserted(spark, target, "id", "version", state)) == want
    assert rows(streams.read_upserted(spark, target, "id", "version")) == want


def test_scratch_tables_are_removed(spark):
    with scratch(spark) as folder:
        kept = materialize(spark.range(5))
        assert kept.count() == 5 and all(folder in f for f in kept.inputFiles())
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_resume_processes_each_file_once(spark, rows):
    source, out = fresh_path(spark, "test-inbox"), fresh_path(spark, "test-out")
    spark.range(10).repartition(3).write.parquet(source)
    schema = spark.range(1).schema

    def run(transform):
        streams.incremental_process(spark, source, schema, out, out + "-ckpt", transform, max_files=1).awaitTermination()

    def fails_on_seven(frame):
        return frame.select(F.when(F.col("id") == 7, F.raise_error(F.lit("crash"))).otherwise(F.col("id")).cast("long").alias("id"))

    with pytest.raises(Exception):
        run(fails_on_seven)
    run(lambda frame: frame)
    spark.range(10, 15).write.mode("append").parquet(source)
    run(lambda frame: frame)
    assert [r[0] for r in spark.read.parquet(out).orderBy("id").collect()] == list(range(15))


def test_first_batches_stop_and_resume(spark):
    source = fresh_path(spark, "test-steps")
    spark.range(40).repartition(8, "id").write.parquet(source)
    stream = streams.stream_corpus(spark, source, spark.range(1).schema, max_files=1)
    seen = []

    def handle(batch, number):
        seen.extend(r["id"] for r in batch.collect())

    assert streams.first_batches(stream, handle, 3, source + "-ckpt") == [0, 1, 2]
    assert 0 < len(seen) < 40
    assert streams.first_batches(stream, handle, 100, source + "-ckpt")[0] == 3
    assert sorted(seen) == list(range(40))

    def fails(batch, number):
        raise ValueError("broken")

    with pytest.raises(Exception):
        streams.first_batches(stream, fails, 1, source + "-other")


def test_latest_changes_of_many_keys_and_null(spark, rows, monkeypatch):
    # Keys share groups, each of which is one entry of the state store.
    monkeypatch.setattr(state, "BUCKETS", 3)
    source, out = fresh_path(spark, "test-many"), fresh_path(spark, "test-many-latest")
    schema = "k long, version long"
    for run in range(2):
        data = [(k, v) for k in [*range(50), 2**53 + 1, None] for v in (run, run + 1 if k is None or k % 2 else 0)]
        spark.createDataFrame(data, schema).write.mode("append").parquet(source)
        stream = streams.stream_corpus(spark, source, spark.createDataFrame([], schema).schema)
        changed = state.latest_changes(stream, "k", "version")
        streams.stream_to_parquet(changed, out, f"{out}-c").awaitTermination()
    assert spark.read.format("statestore").option("stateVarName", "latest").load(f"{out}-c").count() <= 4
    got = {}
    for k, version, changes in spark.read.parquet(out).collect():
        got.setdefault(k, []).append((changes, version))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(1, 1), (2, 2)] if k is None or k % 2 else [(1, 0), (2, 1)] for k in [*range(50), 2**53 + 1, None]}
