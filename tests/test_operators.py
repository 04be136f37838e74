"""Operators against brute force, on skewed data and at their limits."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.operators import classify, joins, ordering, prompts, sampling, search, sets, similar, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group, a third of all values equal."""
    rng = random.Random(1)
    data = []
    for i in range(30_000):
        group = "hot" if i % 2 else rng.choice(["a", "b", None])
        value = 7.0 if i % 3 == 0 else round(rng.gauss(0, 50), 3)
        data.append((i, group, value if i % 49 else None))
    return data, spark.createDataFrame(data, "id long, g string, v double").repartition(6).cache()


def test_exact_quantiles_of_large_skewed_groups(skewed):
    data, frame = skewed
    wanted = {"q0": 0.0, "q5": 0.05, "p50": 0.5, "q501": 0.501, "q95": 0.95, "q100": 1.0}
    got = {r["g"]: r for r in ordering.exact_quantiles(frame, "v", wanted, ["g"]).collect()}
    for group in ("hot", "a", "b", None):
        values = [v for _, g, v in data if g == group and v is not None]
        assert [got[group][n] for n in wanted] == pytest.approx(np.quantile(values, list(wanted.values())))
    whole = ordering.exact_quantiles(frame, "v", wanted).first()
    values = [v for _, _, v in data if v is not None]
    assert [whole[n] for n in wanted] == pytest.approx(np.quantile(values, list(wanted.values())))


def test_exact_quantiles_of_one_value_and_none(spark):
    frame = spark.createDataFrame([("a", 3), ("a", 3), ("b", None)], "g string, v int")
    assert [tuple(r) for r in ordering.exact_quantiles(frame, "v", {"m": 0.5}, ["g"]).collect()] == [("a", 3.0)]
    assert ordering.exact_quantiles(frame.filter("v > 9"), "v", {"m": 0.5}).first()["m"] is None


def test_running_totals(skewed, spark):
    data, frame = skewed
    counts = frame.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = ordering.running_totals(counts, [F.desc_nulls_last("v")], ["n"], ["g"]).collect()
    for group in ("hot", "a", None):
        n = Counter(v for _, g, v in data if g == group)
        run, expected = 0, {}
        for v in sorted((x for x in n if x is not None), reverse=True) + ([None] if None in n else []):
            run += n[v]
            expected[v] = run
        assert {r["v"]: r["run_n"] for r in got if r["g"] == group} == expected
        assert {r["all_n"] for r in got if r["g"] == group} == {run}


def test_row_index_is_dense(skewed):
    data, frame = skewed
    got = ordering.row_index(frame, [F.desc("v"), "id"], start=5).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(5, 5 + len(data)))
    want = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert [r["id"] for r in got] == [r[0] for r in want]


@pytest.mark.parametrize("n", [0, 1, 1000, 29_999, 30_000, 99_999])
def test_sample_n_is_exact(skewed, n):
    _, frame = skewed
    assert sampling.sample_n(frame, n, 42, "id").count() == min(n, 30_000)


def test_sample_does_not_depend_on_partitioning(skewed, rows):
    _, frame = skewed
    again = frame.repartition(3, "v")
    assert rows(sampling.sample_n(frame, 50, 7, "id"), "id") == rows(sampling.sample_n(again, 50, 7, "id"), "id")


def test_stratified_split(skewed):
    _, frame = skewed
    split = sampling.stratified_split(frame, ["g"], 0.2, 42, "id")
    assert split.count() == 30_000 and split.select("id").distinct().count() == 30_000
    for r in split.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test")).collect():
        assert r["test"] == int(0.2 * r["n"] + 0.5)


def test_stratified_split_of_tiny_strata(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "b", "b", "c", "c", "c"])], "id int, s string")
    got = {(r["s"], r["split"]): r["count"] for r in sampling.stratified_split(frame, ["s"], 0.2, 1, "id").groupBy("s", "split").count().collect()}
    assert got == {("a", "train"): 1, ("b", "train"): 2, ("c", "test"): 1, ("c", "train"): 2}


def test_train_test_split_is_a_partition(skewed):
    _, frame = skewed
    split = sampling.train_test_split(frame, {"train": 0.7, "valid": 0.2, "test": 0.1}, 3, "id")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 30_000
    assert sizes["train"] == pytest.approx(21_000, rel=0.03) and sizes["test"] == pytest.approx(3_000, rel=0.1)
    assert sampling.train_test_split(frame, {"all": 1.0}, 3, "id").filter("split = 'all'").count() == 30_000
    with pytest.raises(ValueError):
        sampling.train_test_split(frame, {"a": 0.5}, 3, "id")


def test_drop_duplicates_prunes_before_the_shuffle(skewed, rows):
    data, frame = skewed
    kept = stats.drop_duplicates(frame, ["g"], ["id"])
    want = {g: min(i for i, h, _ in data if h == g) for g in ("hot", "a", "b", None)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r["g"]: r["id"] for r in kept.collect()} == want
    last = stats.drop_duplicates(frame, ["g"], ["id"], keep="last")
    assert max(r["id"] for r in last.collect()) == 29_999


def test_label_cooccurrence(spark):
    lists = [["a", "b"], ["b", "a", "b"], ["a"], ["c", "a", "b"], [], None]
    frame = spark.createDataFrame([(x,) for x in lists], "l array<string>")
    got = {(r["label_1"], r["label_2"]): r["n"] for r in stats.label_cooccurrence(frame, "l").collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    assert [tuple(r) for r in stats.top_label_pairs(frame, "l", 2).collect()] == [("a", "b", 3), ("a", "c", 1)]
    assert stats.annotator_disagreement(frame, "l").count() == 3
    assert stats.disagreeing_combinations(frame, "l").count() == 3


def test_group_members_splits_large_groups(spark):
    frame = spark.createDataFrame([(i, ["hot", f"k{i % 3}"]) for i in range(3000)], "id int, tasks array<string>")
    assert stats.group_members(frame, "tasks", "id").filter("key = 'hot'").agg(F.countDistinct("member"), F.min("n_members")).first() == (3000, 3000)
    got = stats.group_member_lists(frame, "tasks", "id", per_row=200).collect()
    hot = [r for r in got if r["key"] == "hot"]
    assert len(hot) == 15 and max(len(r["members"]) for r in hot) < 300
    assert sorted(m for r in hot for m in r["members"]) == list(range(3000))
    assert all(r["members"] == sorted(r["members"]) for r in got)


def test_pivot_and_back(spark, rows):
    frame = spark.createDataFrame([("x", 0), ("x", 1), ("x", 1), ("y", 0)], "r string, c int")
    wide = stats.pivot_counts(frame, "r", "c", [0, 1, 2])
    assert rows(wide) == [("x", 1, 2, 0), ("y", 1, 0, 0)]
    long = stats.unpivot_long(wide, ["r"], ["0", "1", "2"]).filter("value > 0")
    assert rows(long) == [("x", "0", 1), ("x", "1", 2), ("y", "0", 1)]
    assert rows(stats.row_percentages(wide, ["0", "1", "2"])) == [("x", 33.33, 66.67, 0.0), ("y", 100.0, 0.0, 0.0)]


def test_percent_true_ignores_null_flags(spark):
    frame = spark.createDataFrame([("x", True), ("x", None), ("x", False), ("y", None)], "g string, f boolean")
    got = {r["g"]: (r["percent"], r["n"]) for r in stats.percent_true(frame, "g", "f").collect()}
    assert got == {"x": (50.0, 2), "y": (None, 0)}


def test_null_counts(spark):
    frame = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 3.0), (None, None)], "g string, v double")
    assert tuple(stats.n_unique(frame, ["g", "v"]).first()) == (2, 3)
    got = stats.describe(frame, ["v"]).first()
    assert (got["count"], got["null_count"], got["mean"], got["p50"]) == (2, 2, 2.0, 2.0)
    by = {r["g"]: r for r in stats.describe_by(frame, ["g"], "v").collect()}
    assert by[None]["p75"] == 1.0 and by["a"]["count"] == 1 and by["a"]["std"] is None
    assert stats.coverage_ratio(frame, "g").first()["ratio"] == 0.5


def test_histogram_edges(spark):
    frame = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 9, 10)], "v double")
    got = [(r["bin"], r["left_edge"], r["n"]) for r in stats.histogram(frame, "v", 5).orderBy("bin").collect()]
    assert got == [(0, 0.0, 3), (1, 2.0, 1), (2, 4.0, 0), (3, 6.0, 0), (4, 8.0, 2)]
    flat = stats.histogram(spark.createDataFrame([(4,), (4,)], "v int"), "v", 2).orderBy("bin").collect()
    assert [(r["left_edge"], r["n"]) for r in flat] == [(3.5, 0), (4.0, 2)]


def test_outer_join_keeps_both_sides(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, r string")
    got = rows(joins.join_annotations_outer(left, right, "k"), "k", "l", "r")
    assert got == rows(left.join(right, "k", "full"), "k", "l", "r")


def test_lookup_join_keeps_unknown(spark, rows):
    frame = spark.createDataFrame([(1, 5), (2, 9)], "id int, c int")
    table = spark.createDataFrame([(5, "five")], "k int, name string")
    assert rows(joins.lookup_join(frame, table, "c", "k"), "id", "name") == [(1, "five"), (2, None)]


def test_union_typed(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, p string"), spark.createDataFrame([(2, 0.5)], "id int, q double")
    got = sets.union_typed({"model": a, "dataset": b}).select("type", "id", "p", "q").collect()
    assert [tuple(r) for r in got] == [("model", 1, "x", None), ("dataset", 2, None, 0.5)]


# ---- prompts


def test_prompt_templates(spark):
    frame = spark.createDataFrame([(1, "body text"), (2, None)], "id int, t string")
    got = [r["prompt"] for r in prompts.render_prompt(frame, "summary", "id", "t", max_len=4).collect()]
    assert "record 1" in got[0] and "\nbody\n" in got[0] and "text" not in got[0] and got[1] is None
    with pytest.raises(ValueError):
        prompts.prompt_template("missing")


def test_fewshot_prompt(spark):
    frame = spark.createDataFrame([(i, "g", f"Do  thing {i}:") for i in range(3)], "id int, g string, t string")
    text = prompts.fewshot_prompt(frame, "g", "t", "id", 8, 1, classification=True).first()["prompt"]
    lines = text.split("\n")
    assert lines[0].startswith("Come up with a series of classification tasks.") and lines[-1] == "4."
    assert sorted(x.split(". ", 1)[1] for x in lines[1:-1]) == ["Do thing 0", "Do thing 1", "Do thing 2"]


def test_generate_batch_isolates_failures(spark):
    def load():
        def model(batch):
            if any(p == "bad" for p in batch):
                raise RuntimeError("refused")
            return [p.upper() for p in batch]

        return model

    texts = ["a", "bad", "b", None, "c"]
    frame = spark.createDataFrame([(i, t, None if i else 2**60) for i, t in enumerate(texts)], "id int, p string, n long")
    got = prompts.generate_batch(frame.coalesce(1), "p", "out", load, batch_size=3).orderBy("id").collect()
    assert [r["out"] for r in got] == ["A", None, "B", None, "C"] and got[0]["n"] == 2**60
    assert [r["out_error"] is None for r in got] == [True, False, True, False, True] and "refused" in got[1]["out_error"]


def test_generate_batch_keeps_answers_on_their_rows(spark):
    def load():
        def model(batch):  # too few answers in one chunk, too many in the next
            return [p.upper() for p in batch[:-1]] if "b" in batch else [p.upper() for p in batch] + ["extra"] * (len(batch) > 1)

        return model

    frame = spark.createDataFrame([(i, p) for i, p in enumerate("abcde")], "id int, p string")
    got = prompts.generate_batch(frame.coalesce(1), "p", "out", load, batch_size=3).orderBy("id").collect()
    assert [r["out"] for r in got] == ["A", None, "C", "D", "E"]
    assert got[1]["out_error"] == "ValueError: 0 answers to 1 prompts"


def test_chat_pivot_splits_long_conversations(spark, rows):
    turns = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(25)] + [(2, 0, "user", "only")]
    random.Random(0).shuffle(turns)
    frame = spark.createDataFrame(turns, "c int, turn long, role string, text string")
    chats = prompts.chat_pivot(frame, "c", "turn", "role", "text", per_row=10).orderBy("c", "part").collect()
    assert [(r["c"], r["part"], len(r["messages"])) for r in chats] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1)]
    assert [m["content"] for r in chats if r["c"] == 1 for m in r["messages"]] == [f"t{i}" for i in range(25)]
    for per_row in (1, 4, 100):
        back = prompts.chat_unpivot(prompts.chat_pivot(frame, "c", "turn", "role", "text", per_row=per_row), "c")
        assert sorted(map(tuple, back.collect())) == sorted(turns)


def test_pairs_from_good_bad(spark, rows):
    frame = spark.createDataFrame([("s", ["g1", "g2"], ["b1"]), ("t", [], None)], "s string, good array<string>, bad array<string>")
    assert rows(prompts.pairs_from_good_bad(frame, "s")) == [("s", "b1", 0), ("s", "g1", 1), ("s", "g2", 1)]


# ---- classifiers


def curve(scored):
    positives = sum(y for y, _ in scored)
    points = []
    for t in sorted({s for _, s in scored}):
        hit = [y for y, s in scored if s >= t]
        points.append((t, sum(hit) / len(hit), sum(hit) / positives if positives else 1.0))
    return points


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    data = []
    for i in range(2000):
        y = int(rng.random() < 0.3)
        s = 0.5 if i % 3 == 0 else round(min(max(rng.gauss(0.4 + 0.3 * y, 0.2), 0.0), 1.0), 3)
        data.append((y, s))
    return data, spark.createDataFrame(data, "y int, s double").repartition(5)


def test_pr_curve_and_areas(scored):
    data, frame = scored
    got = [tuple(r)[:3] for r in classify.pr_curve(frame, "y", "s").orderBy("threshold").collect()]
    want = curve(data)
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, want))
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for _, precision, recall in reversed(want):
        ap, last = ap + (recall - last) * precision, recall
    areas = classify.roc_auc_ap(frame, "y", "s").first()
    assert areas["roc_auc"] == pytest.approx(auc) and areas["average_precision"] == pytest.approx(ap)


@pytest.mark.parametrize("min_precision, floor", [(0.5, 0.5), (0.9, 0.5), (1.1, 0.5), (0.9, 0.99999), (0.2, 0.0)])
def test_choose_threshold(scored, min_precision, floor):
    data, frame = scored
    points = [p for p in curve(data) if p[0] >= floor]
    good = [p for p in points if p[1] >= min_precision]
    if good:
        want = good[0]
    elif points:
        want = max(points, key=lambda p: (p[1], -p[0]))
    else:
        want = (floor, 0.0, 0.0)
    got = classify.choose_threshold(frame, "y", "s", min_precision, floor).first()
    assert (got["threshold"], got["precision"], got["recall"]) == pytest.approx(want)
    assert got["max_prob"] == max(s for _, s in data) and got["mean_prob"] == pytest.approx(np.mean([s for _, s in data]))


def test_choose_threshold_above_all_scores(spark):
    frame = spark.createDataFrame([(1, 0.2), (0, 0.1)], "y int, s double")
    got = classify.choose_threshold(frame, "y", "s").first()
    assert (got["threshold"], got["precision"], got["recall"], got["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_threshold_grid(scored):
    data, frame = scored
    grid = classify.dense_grid(0.5, 0.7, 0.95)
    assert grid == sorted(set(grid)) and grid[0] == 0.5 and grid[-1] == 0.95
    positives = sum(y for y, _ in data)
    got = classify.threshold_grid(frame, "y", "s", grid + [2.0]).orderBy("threshold").collect()
    assert [r["threshold"] for r in got] == grid + [2.0]
    for r in got:
        hit = [y for y, s in data if s >= r["threshold"]]
        precision = sum(hit) / len(hit) if hit else 0.0
        assert r["precision"] == pytest.approx(precision) and r["recall"] == pytest.approx(sum(hit) / positives)
        assert r["f1"] == pytest.approx(2 * sum(hit) / (len(hit) + positives))


def test_metrics_without_positives(spark):
    frame = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    got = classify.binary_metrics(frame, "y", "p").first()
    assert (got["precision"], got["recall"], got["f1"], got["specificity"]) == (0.0, 0.0, 0.0, 1.0)
    none = spark.createDataFrame([(0, 0.3)], "y int, s double")
    assert tuple(classify.roc_auc_ap(none, "y", "s").first()) == (None, None)


def test_classifier_learns(spark):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(50)]
    data = []
    for i in range(400):
        bad = int(i % 4 == 0)
        words = rng.choices(common, k=20) + (["spam"] * 2 if bad else [])
        data.append((i, " ".join(words), f"h{bad}", bad))
    frame = spark.createDataFrame(data, "id int, t string, host string, y int")
    model = classify.train_quality_filter(frame, "t", "y", categories=["host"], balanced=True)
    out = classify.score_corpus(model, frame, "id", "t", categories=["host"], keep=["y"])
    assert out.columns == ["id", "y", "label", "confidence", "score"]
    assert classify.binary_metrics(out, "y", "label").first()["accuracy"] > 0.95
    empty = spark.createDataFrame([(1, None, "h0")], "id int, t string, host string")
    assert classify.score_corpus(model, empty, "id", "t", categories=["host"]).count() == 1


def test_param_sweep(spark):
    data = [(i, ("good " if i % 2 else "bad ") + f"w{i % 7}", i % 2) for i in range(60)]
    frame = spark.createDataFrame(data, "id int, t string, y int")
    trials = classify.param_sweep(frame, frame, "t", "y", {"reg": [0.1, 1.0]}, first={"reg": 0.5}).orderBy("number").collect()
    assert [r["params_reg"] for r in trials] == [0.5, 0.1, 1.0]
    assert all(r["value"] > 0.9 and r["seconds"] > 0 for r in trials)


# ---- search


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8))
    x[100:230] = x[3]  # a third of all rows are copies
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    return x.astype(np.float32).astype(np.float64), frame


def brute(x, q, k, metric, skip=None):
    if metric == "l2":
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
    elif metric == "dot":
        d = -(x @ q)
    else:
        d = 1 - (x @ q) / np.sqrt((x * x).sum(axis=1) * (q @ q))
    order = [i for i in sorted(range(len(x)), key=lambda i: (round(d[i], 9), i)) if i != skip][:k]
    return order, d[order]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_knn_exact(points, metric):
    x, frame = points
    got = search.knn_exact(frame, x[5].tolist(), 7, "id", "v", metric).collect()
    ids, d = brute(x, x[5], 7, metric)
    assert [r["id"] for r in got] == ids and [r["distance"] for r in got] == pytest.approx(d.tolist(), abs=1e-9)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_knn_join(points, metric, broadcast_bytes):
    x, frame = points
    near = search.knn_join(
        frame, frame, 5, "id", "v", metric, exclude_self=True, broadcast_bytes=broadcast_bytes, block_rows=90
    ).collect()
    assert len(near) == 5 * len(x)
    for i in (0, 3, 17, 150, 399):
        got = sorted(((r["rank"], r["row_id"], r["distance"]) for r in near if r["query_id"] == i))
        ids, d = brute(x, x[i], 5, metric, skip=i)
        assert [g[2] for g in got] == pytest.approx(d.tolist(), abs=1e-9)
        if i not in (3, 150):  # among copies, rounding may order equal distances differently
            assert [g[1] for g in got] == ids


def test_knn_with_fewer_rows_than_k(points):
    _, frame = points
    few = frame.filter("id < 3")
    assert search.knn_join(few, few, 5, "id", "v", exclude_self=True).count() == 6
    assert search.knn_join(frame.filter("id < 0"), frame, 5, "id", "v").count() == 0


def test_knn_approx_finds_the_copies(points):
    x, frame = points
    got = search.knn_approx(frame, x[3].tolist(), 20, "id", "v").collect()
    assert len(got) == 20 and max(r["distance"] for r in got) < 1e-6
    few = search.knn_approx(frame, x[5].tolist(), 50, "id", "v", bucket=0.02, tables=1).collect()
    assert len({r["id"] for r in few}) == 50  # filled up where hashing finds fewer


def test_maxsim(points, spark):
    x, frame = points
    docs = frame.withColumn("doc", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 5)))
    query = [x[0].tolist(), x[9].tolist()]
    got = {r["doc"]: r["score"] for r in search.maxsim_score(docs, "doc", "v", query).collect()}
    sims = x @ np.array(query).T
    members = {"hot": [i for i in range(400) if i % 2 == 0]}
    for i in range(1, 400, 2):
        members.setdefault(f"d{i % 5}", []).append(i)
    assert got == pytest.approx({d: sims[m].max(axis=0).sum() for d, m in members.items()})
    with pytest.raises(ValueError):
        search.bounded_vectors(frame, "id", "v", limit=10)


def test_bucket_search_compares_few_pairs(spark):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((2000, 64)))], "id long, v array<double>")
    pairs = similar.bucket_pairs(frame, "id", "v", bits=12, tables=32)
    assert pairs <= 0.02 * 2000 * 2000
    assert similar.recall_at(0.95, 12, 32) > 0.999 and similar.recall_at(0.0, 12, 32) < 0.01


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_semantic_dedup(spark, threshold):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    x = []
    for i in range(600):
        center = base[0] if i % 3 == 0 else base[rng.integers(40)]
        x.append(center + rng.standard_normal(16) * rng.choice([0, 0.05, 0.3]))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [0.0] * 16)]
    frame = spark.createDataFrame(data, "id long, v array<double>").repartition(5)
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    want = [i for i in range(600) if not (sims[i, :i] >= threshold).any()] + [600, 601, 602]
    kept = similar.semantic_dedup(frame, "id", "v", threshold, bits=1, tables=12, block_rows=37)
    assert sorted(r["id"] for r in kept.collect()) == want


def test_knn_join_approx_finds_close_neighbours(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((30, 16))
    centers[:10] = centers[0]  # a third of all rows crowd around one center
    x = np.repeat(centers, 12, axis=0) + 0.05 * rng.standard_normal((360, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    near = similar.knn_join_approx(frame, frame, 5, "id", "v", exclude_self=True, bits=4, tables=16, block_rows=50).collect()
    assert all(r["query_id"] != r["row_id"] and r["rank"] <= 5 for r in near)
    assert len({(r["query_id"], r["row_id"]) for r in near}) == len(near)
    got, right = {}, 0
    for r in near:
        got.setdefault(r["query_id"], set()).add(r["row_id"])
    for i in range(360):
        right += len(got.get(i, set()) & set(brute(x, x[i], 5, "cosine", skip=i)[0]))
    assert right > 0.95 * 5 * 360


def test_registered_knn_join_approx_reaches_the_nearest(spark, tables):
    import __spark_entry__

    queries = __spark_entry__.queries()
    want = {(r["query_id"], r["row_id"]) for r in queries["knn_join_blocks"](spark, tables).collect()}  # exact, cosine
    got = {(r["query_id"], r["row_id"]) for r in queries["knn_join_approx"](spark, tables).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_heavy_hitters(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("rare"), F.col("id"))).otherwise(F.concat(F.lit("w"), F.floor(F.sqrt(F.col("id") % 60)))).alias("w"))
    rows = rows.unionByName(spark.range(500).select(F.lit(None).cast("string").alias("w")))
    want = [tuple(r) for r in stats.value_counts(rows, "w", top=5).collect()]
    plain = stats.value_counts
    full = []
    monkeypatch.setattr(stats, "value_counts", lambda r, *a, **k: (full.append(r is rows), plain(r, *a, **k))[1])
    assert [tuple(r) for r in stats.heavy_hitters(rows, "w", 5, tracked=1000).collect()] == want and not any(full)
    # What the summary cannot prove is counted in full: many equally frequent values, and few values.
    flat = spark.range(5000).select((F.col("id") % 2500).cast("string").alias("w"))
    assert [tuple(r) for r in stats.heavy_hitters(flat, "w", 4, tracked=100).collect()] == [tuple(r) for r in plain(flat, "w", top=4).collect()]
    few = rows.filter("w = 'w3'")
    assert [tuple(r) for r in stats.heavy_hitters(few, "w", 4).collect()] == [("w3", few.count())]
    assert stats.heavy_hitters(rows.limit(0), "w", 4).collect() == []


def test_planted_neighbours_are_found_among_nearer_rows(spark, tmp_path):
    import __spark_entry__

    # Every vector but the first is nearer to the first one's copies than its own turned copy is.
    rng = np.random.default_rng(6)
    middle = rng.standard_normal(16)
    data = [(i, (middle + 0.001 * i * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(12)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = __spark_entry__.queries()["knn_join_approx_planted"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["row_id"]) for r in got) == [(i, i + n * 1_000_000) for i in range(12) for n in (1, 2, 3)]


def test_blocks_of_two_large_tables_are_sent_to_few_tasks(points, monkeypatch):
    # Blocks of 1,000 rows sent each of 600,000 vectors to 600 tasks.
    assert search.side_parts(600_000, 520, 1000, 12) == 5
    assert search.side_parts(0, 520, 1000, 12) == 1 and search.side_parts(3000, 520, 1000, 12) == 3
    monkeypatch.setattr(search, "MATRIX_CELLS", 64)
    x, frame = points
    near = search.knn_join(frame, frame, 5, "id", "v", "l2", exclude_self=True, broadcast_bytes=0, block_rows=7).collect()
    got = {(r["query_id"], r["rank"]): r["distance"] for r in near}
    assert len(got) == len(near) == 5 * len(x)
    for i in (0, 17, 399):
        assert [got[i, n + 1] for n in range(5)] == pytest.approx(brute(x, x[i], 5, "l2", skip=i)[1].tolist(), abs=1e-9)


def test_generate_batch_holds_one_call_of_prompts():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.types import StructType

    class Rows:
        schema = StructType()

        def mapInArrow(self, run, schema):
            return run

    run = prompts.generate_batch(Rows(), "p", "out", lambda: lambda texts: [x[:3] for x in texts], batch_size=10)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:05d}" * 4000 for i in range(1000)])], ["p"])  # 20 MB of prompts
    tracemalloc.start()
    try:
        (out,) = run(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out["out"].to_pylist() == [f"{i:05d}"[:3] for i in range(1000)] and peak < 4 << 20


def test_semantic_dedup_exchanges_half_precision_and_decides_exactly(spark):
    # Pairs on both sides of the threshold, closer to it than half precision can tell.
    rng = np.random.default_rng(8)
    data, want = [], []
    for i in range(40):
        x, y = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        cos = 0.9 + (1e-5 if i % 2 else -1e-5) * (1 + i)
        data += [(2 * i, x.tolist()), (2 * i + 1, (cos * x + np.sqrt(1 - cos * cos) * y).tolist())]
        want += [2 * i] if i % 2 else [2 * i, 2 * i + 1]
    frame = spark.createDataFrame(data, "id long, v array<double>").repartition(3)
    unit = np.array([v for _, v in data])
    near = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    assert [tuple(p) for p in near] == [(2 * i, 2 * i + 1) for i in range(1, 40, 2)]
    kept = similar.semantic_dedup(frame, "id", "v", 0.9, bits=1, tables=12, block_rows=10)
    assert sorted(r["id"] for r in kept.collect()) == want
    halved = similar._halved(similar._with_buckets(frame, 1, 12, 42)).collect()
    assert all(len(r["v"]) == 2 * 32 for r in halved)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_best_rows_over_many_blocks(metric, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "MATRIX_ROWS", 13)
    monkeypatch.setattr(search, "PAIRS", 11)
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(60, 5)), np.ones((30, 5)), np.zeros((2, 5)), 1e4 + 1e-4 * rng.normal(size=(20, 5))])
    ids, codes = rng.permutation(len(vectors)), rng.integers(0, 3, (len(vectors), 2)).astype(np.uint8)
    for own in (None, codes):
        nearest = search.Nearest(ids[:80], vectors[:80], 4, metric, True, None if own is None else own[:80])
        for a in range(0, len(ids), 31):
            nearest.meet(ids[a : a + 31], vectors[a : a + 31], None if own is None else own[a : a + 31])
        got = [tuple(r) for part in nearest.found() for r in part[["query_id", "row_id"]].to_numpy().tolist()]
        want = []
        for q in range(80):
            others = np.array([r for r in range(len(ids)) if r != q and (own is None or (own[q] == own[r]).any())])
            d = search._pair_distances(np.repeat(vectors[q : q + 1], len(others), axis=0), vectors[others], metric)
            want.extend((ids[q], ids[others[i]]) for i in np.lexsort((ids[others], d))[:4])
        assert got == want


def test_wide_buckets_look_at_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(similar, "_meet_in_buckets", None)  # meets pairs once per table
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(120, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(3)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = ((unit @ np.random.default_rng(42).standard_normal((6, 8))) > 0).reshape(120, 4, 2)
    shares = (signs[:, None] == signs[None]).all(axis=3).any(axis=2)
    far = np.where(shares & ~np.eye(120, dtype=bool), 1 - unit @ unit.T, np.inf)
    got = similar.knn_join_approx(frame, frame, 3, "id", "v", exclude_self=True, bits=2, tables=4).collect()
    mine = {(r.query_id, r["rank"]): r.row_id for r in got}
    assert mine == {(q, n + 1): r for q in range(120) for n, r in enumerate(np.argsort(far[q])[:3]) if far[q, r] < np.inf}


@pytest.mark.parametrize("block_rows, by_bucket", [(5000, False), (7, False), (2, True)])
def test_rows_of_a_group_are_sent_once_and_meet_as_by_bucket(spark, monkeypatch, block_rows, by_bucket):
    # Groups of many sizes, one of them null: packed, cut into blocks, or (more than 8 blocks) bucket by bucket.
    monkeypatch.setattr(similar, "PAIRS", 40, raising=False)
    sent, plain = [], similar._meet_in_buckets
    monkeypatch.setattr(similar, "_meet_in_buckets", lambda *a: (sent.append(a), plain(*a))[1])
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(150, 6))
    of = [None if i % 10 == 9 else "one" if i % 3 == 0 else f"g{i % 23}" for i in range(150)]
    frame = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(vectors, of))] + [(150, [0.0] * 6, "one"), (151, None, "one")], "id long, v array<double>, of string").repartition(3)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = ((unit @ np.random.default_rng(42).standard_normal((6, 24))) > 0).reshape(150, 8, 3)
    shares = (signs[:, None] == signs[None]).all(axis=3).any(axis=2) & np.array([[a == b for b in of] for a in of])
    asked = frame.filter("id % 2 = 0")
    far = np.where(shares & ~np.eye(150, dtype=bool), 1 - unit @ unit.T, np.inf)
    got = similar.knn_join_approx(asked, frame, 3, "id", "v", exclude_self=True, bits=3, tables=8, block_rows=block_rows, group="of").collect()
    mine = {(r.query_id, r["rank"]): r.row_id for r in got}
    assert mine == {(q, n + 1): r for q in range(0, 150, 2) for n, r in enumerate(np.argsort(far[q])[:3]) if far[q, r] < np.inf}
    assert len(sent) == by_bucket  # vectors go once per table only where a group has more than 8 blocks
