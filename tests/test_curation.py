"""Embedding, label search and the whole curation job on small made-up corpora."""

import random

import pytest
from pyspark.sql import functions as F

from curate.operators import search
from curate.plans.curation import curate_corpus
from curate.session import fresh_path
from curate.sources import writers


def test_embeddings_are_unit_vectors_of_the_words(spark):
    frame = spark.createDataFrame(
        [(1, "red widget"), (2, "Widget  red"), (3, "blue bolt"), (4, None), (5, "red bolt")], "id int, text string"
    )
    embedder = search.text_embedder(frame, "text", 64)
    got = {r["id"]: r["embedding"] for r in search.embed_text(frame, "text", embedder).collect()}
    assert got[1] == pytest.approx(got[2]) and got[1] != pytest.approx(got[3])
    assert all(sum(x * x for x in got[i]) == pytest.approx(1.0) for i in (1, 2, 3, 5)) and len(got[4]) == 64


def test_label_search_finds_the_closest_label_set(spark):
    sets = [(1, ["accuracy", "loss"]), (2, ["loss"]), (3, ["recall", "f1"]), (4, ["f1"]), (5, ["loss", "accuracy"])]
    frame = spark.createDataFrame(sets, "id int, labels array<string>")
    embedder = search.text_embedder(frame.select(F.array_join("labels", " ").alias("text")), "text", 256)
    found = search.label_set_search(frame, "labels", "loss accuracy", 3, "id", embedder).collect()
    assert [r["id"] for r in found] == [1, 5, 2]
    assert found[0]["distance"] == pytest.approx(0.0, abs=1e-9)


def test_label_search_costs_words_not_dimensions(spark):
    # Dense vectors of these rows would be 20 GB of numbers, added up one by one.
    sets = spark.range(10_000).selectExpr("id", "array(concat('a', id % 50), concat('b', id % 7)) AS labels")
    sets = sets.unionByName(spark.createDataFrame([(-1, None), (-2, [])], "id long, labels array<string>"))
    embedder = search.text_embedder(sets.select(F.array_join("labels", " ").alias("text")), "text", 1 << 18)
    found = search.label_set_search(sets.repartition(8), "labels", "a3 b3", 28, "id", embedder).collect()
    assert [r["id"] for r in found] == list(range(3, 10_000, 350))[:28]
    assert all(abs(r["distance"]) < 1e-9 for r in found)


def test_curation_drops_what_the_classifier_flags(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(900):
        bad = i % 5 == 0
        docs.append((i, " ".join(rng.choices(words, k=25) + ["spam", "casino"] * bad), rng.choice(["da", "sv"])))
    corpus = spark.createDataFrame(docs, "id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "id long, flag int")
    out = fresh_path(spark, "test-curated")
    kept = curate_corpus(corpus, marks, "id", "text", "lang", "flag", out).collect()
    assert len({r["id"] for r in kept}) == len(kept)
    flagged = sum(r["id"] % 5 == 0 for r in kept)
    assert flagged <= 9 and len(kept) - flagged >= 700
    published = writers.read_published(spark, out)
    assert published.columns == ["id", "text", "lang", "score", "split"] and published.count() == len(kept)
