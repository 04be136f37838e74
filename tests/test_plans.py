"""Shape of the physical plans that the design relies on."""

import re

import pytest

import __spark_entry__

#: Queries of the optional parts have tests of their own.
QUERIES = {n: q for n, q in __spark_entry__.queries().items() if not re.match(r"op\d+_|pipeline$", n)}


def plan(spark, tables, name):
    return QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hardly_broadcast(spark):
    """A limit so low that small test tables do not hide shuffles."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["n_unique", "drop_duplicates"])
def test_texts_are_not_shuffled_or_sorted(spark, tables, name, hardly_broadcast):
    text = plan(spark, tables, name)
    assert not re.search(r"(Exchange|Sort|Expand|HashAggregate)[^\n]*\btext#", text)


def test_token_counts_move_no_text_for_the_distinct(spark, tables):
    assert not re.search(r"(Exchange|Sort|HashAggregate)[^\n]*\btext#", plan(spark, tables, "token_frequencies"))


def test_wide_rows_move_once_for_row_numbers(spark, tables, hardly_broadcast):
    from curate.operators.ordering import row_index

    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "n_chars")
    text = row_index(rows, ["n_chars", "doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(_range", text) or "BroadcastHashJoin" in text


def test_class_weights_do_not_shuffle_rows(spark, tables, hardly_broadcast):
    from curate.operators.classify import balanced_weights

    rows = spark.read.parquet(f"{tables}/labels.parquet")
    weighted = balanced_weights(rows, "quality")
    main = weighted._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main
    got = {r["quality"]: r["w"] for r in weighted.groupBy("quality").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()}
    assert abs(got[0] - got[1]) < 1e-6


@pytest.mark.parametrize(
    "name, columns",
    [
        ("group_mean", "lang:string,n_chars:bigint"),
        ("read_parquet_columns", "doc_id:bigint,source:string"),
        ("len_bytes", "doc_id:bigint,text:string"),
        ("url_tld", "page_id:bigint,url:string"),
        ("stream_filter_count", "url:string"),
    ],
)
def test_only_needed_columns_are_read(spark, tables, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, tables, name)


def test_filters_reach_the_scan(spark, tables):
    assert "PushedFilters: [In(lang, [en,fr])]" in plan(spark, tables, "filter_in")
    assert "GreaterThan(n_chars,200)" in plan(spark, tables, "filter_threshold")


# These run model code or matrices in Python on purpose, or stream.
PYTHON = {"generate_batch", "generate_batch_errors", "knn_join_approx_planted", "knn_join_approx_exact", "knn_join", "knn_join_blocks", "maxsim_score", "semantic_dedup", "knn_join_approx"}
PYTHON |= {
    "knn_join_cells", "knn_join_cells_recall", "maxsim_join", "keyword_hits", "filter_any_keyword_table", "longest_prefix_url",
    "extract_nested_record", "nested_violations", "nested_schema", "user_sessions", "frequent_pairs",
}
EAGER = {
    "train_quality_filter", "score_corpus", "param_sweep", "curation_workflow", "embed_text", "label_set_search",
    "stream_corpus", "incremental_process", "stream_upsert", "knn_approx", "stream_latest_changes",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_python_only_where_meant(spark, tables, name):
    text = plan(spark, tables, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert bool(re.search(r"MapInArrow|MapInPandas|FlatMap|ArrowEval|BatchEval", text)) == (name in PYTHON)


@pytest.mark.parametrize("name", ["url_tld", "train_test_split", "sample_fraction", "extract_json_block", "split_front_matter"])
def test_row_local_operators_do_not_shuffle(spark, tables, name):
    assert "Exchange" not in plan(spark, tables, name)


@pytest.mark.parametrize("name", ["best_per_study", "drop_duplicates", "fewshot_prompt", "knn_join"])
def test_top_rows_per_group_are_pruned_before_the_shuffle(spark, tables, name):
    assert re.search(r"Exchange hashpartitioning.*\n.*WindowGroupLimit.*Partial", plan(spark, tables, name))
