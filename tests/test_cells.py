"""Search by trained cells and the late-interaction join against plain computation on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.operators import cells, late, search


def clusters(seed, centers, around, dim=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dim))
    return np.concatenate([m + 0.05 * rng.normal(size=(around, dim)) for m in middle])


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], "x") for i, v in enumerate(vectors)], "id long, e array<double>, cell string").repartition(4)


@pytest.fixture(scope="module")
def clustered(spark):
    vectors = clusters(1, 40, 25)
    rows = table(spark, vectors)
    return vectors, rows, cells.train_cells(rows, "id", "e", cells=60, parts=5)


def true_nearest(vectors, q, k, cosine=False):
    x = vectors / np.linalg.norm(vectors, axis=1)[:, None] if cosine else vectors
    d = 1 - x @ x[q] if cosine else np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:k]


def test_most_neighbours_are_found_among_few_pairs(spark, clustered):
    vectors, rows, model = clustered
    lists = cells.index_cells(rows, "id", "e", model)
    assert sorted(i for r in lists.collect() for i in r.ids) == list(range(len(vectors)))
    asked = rows.filter("id % 20 = 0")
    got = cells.knn_join_cells(asked, rows, lists, model, 5, "id", "e", probes=4, exclude_self=True).collect()
    found = {q: [r.row_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in range(0, len(vectors), 20)}
    assert all(len(f) == 5 for f in found.values())
    hits = sum(len(set(f) & set(true_nearest(vectors, q, 5))) for q, f in found.items())
    assert hits >= 0.9 * 5 * len(found)
    assert all(np.isclose(r.distance, np.linalg.norm(vectors[r.query_id] - vectors[r.row_id])) for r in got)
    pairs = spark.range(1).select(cells.probed_pairs(asked, "id", "e", model, cells.list_sizes(lists), 6, 4)).first()[0]
    assert pairs < 0.2 * len(found) * len(vectors)


def test_all_cells_give_the_exact_neighbours(spark, clustered):
    vectors, rows, _ = clustered
    model = cells.train_cells(rows, "id", "e", cells=7, parts=4, metric="cosine")
    lists = cells.index_cells(rows, "id", "e", model)
    got = cells.knn_join_cells(rows.filter("id < 30"), rows, lists, model, 3, "id", "e", probes=7, rerank=400, exclude_self=True).collect()
    for q in range(30):
        mine = [r.row_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert mine == true_nearest(vectors, q, 3, cosine=True)


def test_a_cell_with_many_equal_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(cells, "LIST_ROWS", 16)
    monkeypatch.setattr(cells, "LISTS_PER_TASK", 2)
    monkeypatch.setattr(cells, "QUERY_ROWS", 8)
    vectors = np.concatenate([np.ones((300, 4)), clusters(2, 5, 10, 4) + 9])
    rows = table(spark, vectors)
    model = cells.train_cells(rows, "id", "e", cells=6, parts=4)
    lists = cells.index_cells(rows, "id", "e", model)
    sizes = cells.list_sizes(lists).collect()
    assert max(r["parts"] for r in sizes) >= 9 and all(len(r.ids) <= 16 for r in lists.collect())
    got = cells.knn_join_cells(rows, rows, lists, model, 4, "id", "e", probes=1, exclude_self=True).collect()
    assert len(got) == 4 * len(vectors)  # further cells are opened where one holds too few
    assert all(r.distance == 0 for r in got if r.query_id < 300)


def exact_and_all_pairs(queries, rows, model, near, k=5, **more):
    found = cells.knn_join_exact(queries, rows, near, model, k, "id", "e", **more).collect()
    true = search.knn_join(queries, rows, k, "id", "e", exclude_self=more.get("exclude_self", False)).collect()
    return sorted(map(tuple, found)), sorted(map(tuple, true))


def test_neighbours_within_known_limits_are_those_of_all_pairs(spark, clustered, monkeypatch):
    vectors, rows, model = clustered
    for name, few in (("LIST_ROWS", 16), ("LISTS_PER_TASK", 1), ("QUERY_ROWS", 8), ("GATHERED", 50), ("PAIRS", 7)):
        monkeypatch.setattr(cells, name, few)
    rows = rows.unionByName(table(spark, np.repeat(vectors[:1], 120, axis=0), 5000)).unionByName(table(spark, 3 * vectors[:40], 6000))
    asked, lists = rows.filter("id % 10 = 0"), cells.index_cells(rows, "id", "e", model)
    sizes = cells.list_sizes(lists)
    near = cells.knn_join_cells(asked, rows, lists, model, 5, "id", "e", probes=1, rerank=1, exclude_self=True, sizes=sizes)
    assert max(r["parts"] for r in sizes.collect()) > 1
    found, true = exact_and_all_pairs(asked, rows, model, near, exclude_self=True, sizes=sizes)
    assert found == true and len(true) == 5 * asked.count()
    # Without a limit for some queries or any, among few rows, and where the queries are too many to be sent.
    for known in (near.filter("query_id % 3 = 0 AND rank < 4 OR query_id % 3 = 1"), near.limit(0)):
        found, true = exact_and_all_pairs(asked, rows, model, known, exclude_self=True)
        assert found == true
    found, true = exact_and_all_pairs(asked, rows.filter("id < 3"), model, near.limit(0))
    assert found == true and len(true) == 3 * asked.count()
    found, true = exact_and_all_pairs(asked, rows, model, near, exclude_self=True, broadcast_bytes=0)
    assert found == true
    none = rows.limit(0)
    assert exact_and_all_pairs(none, rows, model, near) == exact_and_all_pairs(asked, none, model, near) == ([], [])


def test_queries_meet_few_rows_of_other_cells(clustered):
    vectors, _, model = clustered
    cell, d = model.nearest(vectors), np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    limit = np.sort(d, axis=1)[:, 5]
    met = cells.Unruled(model.centers, np.arange(len(vectors)), vectors, cell, limit, 5, True)
    order = np.argsort(cell, kind="stable")
    met.meet(cell[order], order, vectors[order])
    q, row, _ = met.best()
    assert [row[q == i].tolist() for i in range(0, 1000, 50)] == [true_nearest(vectors, i, 5) for i in range(0, 1000, 50)]
    assert met.compared < 0.2 * len(vectors) ** 2


def test_recall_is_measured_without_all_pairs(spark, tables, monkeypatch):
    from curate.plans.registry import Tables
    from curate.plans.vector_queries import knn_join_cells_recall

    def all_pairs(*args, **more):
        raise AssertionError("all pairs are compared")

    monkeypatch.setattr(search, "knn_join", all_pairs)
    monkeypatch.setattr(cells, "knn_join", all_pairs, raising=False)
    assert all(knn_join_cells_recall(Tables(spark, tables)).select("recall_reached", "pairs_bounded").first())


def test_saved_model_and_odd_vectors(spark, clustered, tmp_path):
    vectors, rows, model = clustered
    cells.save_cells(model, spark, str(tmp_path / "m"))
    again = cells.load_cells(spark, str(tmp_path / "m"))
    assert np.array_equal(again.centers, model.centers) and np.array_equal(again.books, model.books) and again.metric == model.metric
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.1])], "id long, e array<double>")
    one = cells.train_cells(odd, "id", "e", cells=1, metric="cosine")
    near = cells.knn_join_cells(odd, odd, cells.index_cells(odd, "id", "e", one), one, 3, "id", "e", exclude_self=True).collect()
    assert sorted((r.query_id, r.row_id) for r in near) == [(1, 4), (4, 1)]
    none = spark.createDataFrame([], "id long, e array<double>")
    with pytest.raises(ValueError):
        cells.train_cells(none, "id", "e")
    assert cells.knn_join_cells(none, rows, cells.index_cells(rows, "id", "e", model), model, 3, "id", "e").collect() == []
    assert cells.knn_join_cells(rows, none, cells.index_cells(none, "id", "e", model), model, 3, "id", "e").collect() == []


def late_tables(spark, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(30, 8))
    docs = [(d, (middle[d % 30] * (1 + d // 30 / 10) + 0.1 * rng.normal(size=8)).tolist()) for d in range(90) for _ in range(rng.integers(1, 9))]
    docs += [(500, (0.3 * rng.normal(size=8)).tolist()) for _ in range(400)] + [(501, None)]
    asked = [(q, (middle[(q + j) % 30] + 0.2 * rng.normal(size=8)).tolist()) for q in range(12) for j in range(rng.integers(1, 6))]
    return docs, asked, spark.createDataFrame(docs, "doc long, e array<double>").repartition(4), spark.createDataFrame(asked, "q long, e array<double>")


def true_best(docs, asked, k):
    out = {}
    for q in {a for a, _ in asked}:
        mine = np.array([v for a, v in asked if a == q])
        score = {d: (mine @ np.array([v for i, v in docs if i == d and v]).T).max(axis=1).sum() for d in {d for d, v in docs if v}}
        out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("broadcast_bytes, step", [(1 << 20, None), (0, 1 << 7)])
def test_late_interaction_is_exact(spark, broadcast_bytes, step, monkeypatch):
    if step:
        monkeypatch.setattr(late, "MATRIX_CELLS", step)
        monkeypatch.setattr(late, "BLOCK_VECTORS", 50)
    docs, asked, vectors, queries = late_tables(spark, 3)
    centers = cells.train_centers(vectors.filter("e IS NOT NULL").select(F.col("e").alias("v")), 40)
    more = dict(broadcast_bytes=broadcast_bytes, block_rows=30)
    want = true_best(docs, asked, 4)
    got = late.maxsim_join(queries, vectors, 4, "q", "doc", "e", centers, **more).collect()
    for q, best in want.items():
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r.document for r in mine] == [d for d, _ in best]
        assert np.allclose([r.score for r in mine], [s for _, s in best])
    kept = late.candidate_documents(queries, vectors, 4, "q", "doc", "e", centers, **more).collect()
    assert len(kept) < 0.5 * 12 * 91  # most documents are told apart by their bounds
    assert {(q, d) for q, best in want.items() for d, _ in best} <= {(r["query"], r.document) for r in kept}


def test_late_interaction_with_few_documents(spark):
    docs, asked, vectors, queries = late_tables(spark, 4)
    few = vectors.filter("doc < 3")
    got = late.maxsim_join(queries, few, 10, "q", "doc", "e", np.zeros((1, 8))).collect()
    assert len(got) == 3 * 12
    assert late.maxsim_join(queries, vectors.limit(0), 10, "q", "doc", "e", np.zeros((1, 8))).collect() == []
    assert late.maxsim_join(queries.limit(0), vectors, 10, "q", "doc", "e", np.zeros((1, 8))).collect() == []


def test_vectors_of_a_text_embedder_can_be_searched(spark):
    rows = spark.createDataFrame([(i, f"word{i % 5} other{i % 3}") for i in range(60)], "id long, text string")
    embedded = search.embed_text(rows, "text", search.text_embedder(rows, "text", 32))
    model = cells.train_cells(embedded, "id", "embedding", cells=4, metric="cosine")
    lists = cells.index_cells(embedded, "id", "embedding", model)
    near = cells.knn_join_cells(embedded.filter("id = 0"), embedded, lists, model, 3, "id", "embedding", probes=4, exclude_self=True).collect()
    assert all(abs(r.distance) < 1e-9 and r.row_id % 15 == 0 for r in near)


def test_documents_of_close_vectors_are_told_apart_far_from_any_center(spark):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(200, 16))
    docs = [(d, (m + 0.01 * rng.normal(size=16)).tolist()) for d, m in enumerate(middle) for _ in range(5)]
    asked = [(q, (middle[q] + 0.01 * rng.normal(size=16)).tolist()) for q in range(20)]
    vectors, queries = spark.createDataFrame(docs, "doc long, e array<double>"), spark.createDataFrame(asked, "q long, e array<double>")
    kept = late.candidate_documents(queries, vectors, 3, "q", "doc", "e", np.zeros((1, 16))).collect()
    want = true_best(docs, asked, 3)
    assert {(q, d) for q, best in want.items() for d, _ in best} <= {(r["query"], r.document) for r in kept}
    assert len(kept) < 0.05 * 20 * 200


def test_centers_are_those_of_the_clusters(spark):
    vectors = clusters(5, 6, 30)
    centers = cells.train_centers(table(spark, vectors).select(F.col("e").alias("v")), 24)
    away = np.sqrt(((vectors[:, None] - centers[None]) ** 2).sum(axis=2)).min(axis=1)
    assert centers.shape == (24, 12) and away.max() < 0.5
    same = spark.createDataFrame([([1.0, 2.0],)] * 9, "v array<double>")
    assert cells.train_centers(same, 4).tolist() == [[1.0, 2.0]]


def test_clustered_vectors_of_one_piece_go_to_all_cores(spark, tmp_path):
    from types import SimpleNamespace

    from curate.plans.vector_queries import clustered

    spark.range(200).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding").coalesce(1).write.parquet(str(tmp_path / "e"))
    made = clustered(SimpleNamespace(embeddings=spark.read.parquet(str(tmp_path / "e"))))
    assert made.count() == 2000
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 2 * 2000 / len(sizes)


@pytest.mark.parametrize("few, scale", [(32, 1.0), (2, 1e18)])
def test_no_table_of_late_interaction_holds_pairs(spark, monkeypatch, few, scale):
    # Documents far wider than apart: bounds rule out next to nothing. Copies of a document tie.
    monkeypatch.setattr(late, "FEW", few, raising=False)
    rng = np.random.default_rng(12)
    docs = [(d, (scale * rng.normal(size=8)).tolist()) for d in range(60) for _ in range(rng.integers(1, 7))]
    docs += [(d + n, v) for n in (200, 100) for d, v in docs]
    asked = [(q, rng.normal(size=8).tolist()) for q in range(40) for _ in range(rng.integers(1, 5))]
    vectors, queries = spark.createDataFrame(docs, "doc long, e array<double>").repartition(3), spark.createDataFrame(asked, "q long, e array<double>")
    written, plain = [], late.materialize

    def counted(rows, *more):
        out = plain(rows, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(late, "materialize", counted)
    got = late.maxsim_join(queries, vectors, 5, "q", "doc", "e", np.zeros((1, 8))).collect()
    want = true_best(docs, asked, 5)
    for q, best in want.items():
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r.document for r in mine] == [d for d, _ in best]
        assert np.allclose([r.score for r in mine], [s for _, s in best])
    assert max(written) <= 180 < 40 * 180 / 10
