"""Queries on filters, joins, aggregations, samples and set operations."""

from pyspark.sql import functions as F

from curate.operators import filters, joins, sampling, sets, stats
from curate.plans.column_queries import ANNOTATIONS, annotations, tag
from curate.plans.registry import query

# ---- filters


@query("filter_in", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def filter_in(t):
    return t.documents.filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("filter_threshold", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 200")
def filter_threshold(t):
    return t.documents.filter(F.col("n_chars") > 200).select("doc_id", "n_chars")


@query(
    "filter_all",
    """SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 300000 AND year(o_orderdate) = 1997 AND o_orderstatus <> 'F'""",
)
def filter_all(t):
    rows = t.orders.filter(F.col("o_totalprice") > 1000).filter(F.col("o_totalprice") < 300000)
    return rows.filter(F.year("o_orderdate") == 1997).filter("o_orderstatus <> 'F'").select("o_orderkey")


@query(
    "filter_any_keyword",
    """SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'bolt') OR regexp_matches(p_name, 'gear')
         OR regexp_matches(p_type, 'bolt') OR regexp_matches(p_type, 'gear') OR regexp_matches(p_name, 'ECO') OR regexp_matches(p_type, 'ECO')""",
)
def filter_any_keyword(t):
    return filters.filter_any_keyword(t.part, ["p_name", "p_type"], ["bolt", "gear", "ECO"]).select("p_partkey")


@query("filter_exclude", "SELECT page_id FROM pages WHERE NOT contains(url, 'example.com') AND NOT starts_with(url, 'http://')")
def filter_exclude(t):
    kept = t.pages.filter(~F.col("url").contains("example.com") & ~F.col("url").startswith("http://"))
    return kept.select("page_id")


@query("filter_not_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def filter_not_null(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.filter(F.col("quality").isNotNull()).select("doc_id")


@query("filter_quantile", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= (SELECT quantile_cont(n_chars, 0.95) FROM documents)")
def filter_quantile(t):
    return filters.filter_quantile(t.documents.select("doc_id", "n_chars"), "n_chars", 0.95)


@query(
    "drop_invalid_boxes",
    """SELECT vec_id FROM embeddings WHERE NOT (embedding[1] < 0 OR embedding[2] < 0 OR embedding[3] < 0 OR embedding[4] < 0)""",
)
def drop_invalid_boxes(t):
    boxes = [F.struct(F.slice("embedding", i, 2).alias("bbox"), F.lit(i).alias("id")) for i in (1, 3)]
    rows = t.embeddings.select("vec_id", F.array(*boxes).alias("objects"))
    return filters.drop_invalid_boxes(rows).select("vec_id")


SITES = ["http://ththre.example.com/", "https://thther.example.org/en/685", "https://m.", "http://th"]
SITE_LIST = ", ".join(f"'{s}'" for s in SITES)


@query("drop_prefix_url_exact", f"SELECT page_id FROM pages WHERE url NOT IN ({SITE_LIST})")
def drop_prefix_url_exact(t):
    return filters.drop_prefix_url(t.pages.select("page_id", "url"), "url", SITES).select("page_id")


@query(
    "drop_prefix_url",
    "SELECT page_id FROM pages WHERE NOT (" + " OR ".join(f"starts_with(url, '{s}')" for s in SITES) + ")",
)
def drop_prefix_url(t):
    return filters.drop_prefix_url(t.pages.select("page_id", "url"), "url", SITES, "prefix").select("page_id")


# ---- joins


@query("join_metadata", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_metadata(t):
    return joins.join_metadata(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("semi_by_many_ids", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_by_many_ids(t):
    return joins.semi_by_many_ids(t.documents.select("doc_id", "lang", "n_chars"), t.labels.filter("quality = 1"), "doc_id")


@query("anti_by_many_ids", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def anti_by_many_ids(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.anti_by_many_ids(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), done, "l_orderkey")


@query(
    "join_annotations_outer",
    """WITH o AS (SELECT o_custkey AS custkey, o_orderkey FROM orders WHERE o_totalprice > 200000),
            c AS (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal > 0)
       SELECT custkey, o_orderkey, c_name FROM o FULL JOIN c USING (custkey)""",
)
def join_annotations_outer(t):
    orders = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    customers = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), "c_name")
    return joins.join_annotations_outer(orders, customers, "custkey")


@query("semi_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_by_ids(t):
    return joins.semi_by_ids(t.documents.select("doc_id", "n_chars"), t.labels.filter("quality = 1"), "doc_id")


@query("anti_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_by_ids(t):
    return joins.anti_by_ids(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id")


@query("attach_predictions", "SELECT doc_id, lang, quality AS label, toxic / 2 AS score FROM documents LEFT JOIN labels USING (doc_id)")
def attach_predictions(t):
    predictions = t.labels.select("doc_id", F.col("quality").alias("label"), (F.col("toxic") / 2).alias("score"))
    return joins.attach_predictions(t.documents.select("doc_id", "lang"), predictions, "doc_id")


@query(
    "lookup_join",
    """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
         LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_join(t):
    rows = joins.lookup_join(t.customer.select("c_custkey", "c_nationkey"), t.nation, "c_nationkey", "n_nationkey")
    return joins.lookup_join(rows, t.region, "n_regionkey", "r_regionkey").select("c_custkey", "n_name", "r_name")


# ---- aggregations


@query("group_mean", "SELECT lang, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def group_mean(t):
    return stats.group_mean(t.documents, "lang", "n_chars").withColumn("mean", F.round("mean", 6))


@query(
    "group_count_mean_having",
    """WITH p AS (SELECT regexp_extract(url, 'example[.]([a-z]+)', 1) AS tld, length(html) AS size FROM pages)
       SELECT tld, count(size) AS n, round(avg(size), 6) AS mean FROM p GROUP BY tld HAVING count(size) > 60""",
)
def group_count_mean_having(t):
    from curate.functions.urls import url_tld

    pages = url_tld(t.pages, "url").select("tld", F.length("html").alias("size"))
    return stats.group_count_mean_having(pages, "tld", "size", 60).withColumn("mean", F.round("mean", 6))


@query("group_count", "SELECT lang, source, count(*) AS n_rows FROM documents GROUP BY lang, source")
def group_count(t):
    return stats.group_count(t.documents, ["lang", "source"], "n_rows")


def labelled(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id")


@query(
    "percent_true",
    """SELECT lang, 100.0::DOUBLE * CAST(sum(toxic) AS BIGINT) / count(toxic) AS percent, count(toxic) AS n
       FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def percent_true(t):
    return stats.percent_true(labelled(t), "lang", "toxic").orderBy(F.desc("percent"), "lang")


@query(
    "share_of_total",
    "SELECT lang, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang",
)
def share_of_total(t):
    return stats.share_of_total(t.documents, "lang").withColumn("percent", F.round("percent", 6))


@query(
    "value_counts",
    """SELECT source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS proportion FROM documents
       GROUP BY source ORDER BY n DESC, source LIMIT 7""",
)
def value_counts(t):
    counts = stats.value_counts(t.documents, "source", normalize=True, top=7)
    return counts.withColumn("proportion", F.round("proportion", 6))


def described(by, columns, table, extra=""):
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT {by or f"'{c}' AS column"}, count({c}) AS count, count(*) - count({c}) AS null_count, round(avg({c}), 6) AS mean,
            round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(quantile_cont({c}, 0.25), 6) AS p25,
            round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75 FROM {table} {extra}"""
        )
    return " UNION ALL ".join(parts)


def rounded(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@query("describe", described("", ["l_quantity", "l_extendedprice"], "lineitem"))
def describe(t):
    return rounded(stats.describe(t.lineitem, ["l_quantity", "l_extendedprice"]), "mean", "std", "p25", "p50", "p75")


@query("describe_by", described("lang", ["n_chars"], "documents", "GROUP BY lang"))
def describe_by(t):
    return rounded(stats.describe_by(t.documents, ["lang"], "n_chars"), "mean", "std", "p25", "p50", "p75")


@query(
    "count_columns",
    "SELECT count(page_id) AS page_id, count(url) AS url, count(html) AS html FROM pages WHERE contains(url, 'example.org')",
)
def count_columns(t):
    return t.pages.filter(F.col("url").contains("example.org")).agg(*[F.count(c).alias(c) for c in ("page_id", "url", "html")])


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query(
    "n_unique",
    """SELECT count(DISTINCT lang) AS lang, count(DISTINCT source) AS source, count(DISTINCT text) AS text,
         count(DISTINCT quality) + max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS quality
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def n_unique(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return stats.n_unique(joined, ["lang", "source", "text", "quality"])


@query("distinct_values", "SELECT DISTINCT o_orderpriority AS priority FROM orders")
def distinct_values(t):
    return stats.distinct_values(t.orders, "o_orderpriority", "priority")


@query("drop_duplicates", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def drop_duplicates(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("digest"))
    return stats.drop_duplicates(rows, ["digest"], ["doc_id"])


@query(
    "token_frequencies",
    """WITH d AS (SELECT DISTINCT text FROM documents), w AS (SELECT unnest(string_split(lower(text), ' ')) AS token FROM d)
       SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 100""",
)
def token_frequencies(t):
    return stats.token_frequencies(t.documents, "text", "doc_id", lower=True, top=100)


@query(
    "heavy_hitters",
    """WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS token FROM documents)
       SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 20""",
)
def heavy_hitters(t):
    return stats.heavy_hitters(t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("token")), "token", 20)


@query("flat_list_frequencies", ANNOTATIONS + "SELECT item, count(*) AS n FROM (SELECT unnest(labels) AS item FROM a) GROUP BY item")
def flat_list_frequencies(t):
    return stats.flat_list_frequencies(annotations(t), "labels")


@query(
    "count_by_predicate",
    """WITH e AS (SELECT contains(CASE WHEN value > 10 THEN event_type || ':' || user_id ELSE event_type END, ':') AS special FROM events)
       SELECT special, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS proportion FROM e GROUP BY special""",
)
def count_by_predicate(t):
    counts = stats.count_by_predicate(t.events, tag().contains(":"), "special")
    return counts.withColumn("proportion", F.round("proportion", 6))


@query("topk_by_count", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_by_count(t):
    return stats.topk_by_count(t.events, "user_id", 10)


@query(
    "top_categories_filter",
    """SELECT p_partkey, p_brand FROM part WHERE p_brand IN
         (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 9)""",
)
def top_categories_filter(t):
    return stats.top_categories_filter(t.part.select("p_partkey", "p_brand"), "p_brand", 9)


@query(
    "top_within_category",
    """SELECT p_name, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM part
       WHERE p_type = 'ECONOMY' GROUP BY p_name ORDER BY n DESC, p_name LIMIT 30""",
)
def top_within_category(t):
    top = stats.top_within_category(t.part, "p_type", "ECONOMY", "p_name", 30)
    return top.withColumn("percent", F.round("percent", 6))


@query(
    "group_members",
    """WITH m AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key, p_partkey FROM part)
       SELECT key, p_partkey AS member, count(*) OVER (PARTITION BY key) AS n_members FROM m""",
)
def group_members(t):
    rows = t.part.select(F.split("p_name", " ").alias("tasks"), "p_partkey")
    return stats.group_members(rows, "tasks", "p_partkey")


@query(
    "group_member_lists",
    """WITH m AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key, p_partkey FROM part),
            n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_members, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT AS place FROM m)
       SELECT key, CAST(place % CAST(ceil(n_members / 50) AS BIGINT) AS BIGINT) AS part, max(n_members) AS n_members,
         string_agg(p_partkey, ',' ORDER BY p_partkey) AS members FROM n GROUP BY key, 2""",
)
def group_member_lists(t):
    rows = t.part.select(F.split("p_name", " ").alias("tasks"), "p_partkey")
    members = F.array_join(F.col("members").cast("array<string>"), ",")
    return stats.group_member_lists(rows, "tasks", "p_partkey", per_row=50).withColumn("members", members)


PIVOT = """WITH c AS (SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1
                      FROM documents JOIN labels USING (doc_id) GROUP BY lang) """


def label_table(t):
    wide = stats.pivot_counts(labelled(t), "lang", "quality", [0, 1])
    return wide.withColumnsRenamed({"0": "q0", "1": "q1"})


@query("pivot_counts", PIVOT + "SELECT * FROM c")
def pivot_counts(t):
    return label_table(t)


@query(
    "row_percentages",
    PIVOT + "SELECT lang, round(q0 * 100.0::DOUBLE / (q0 + q1), 6) AS q0, round(q1 * 100.0::DOUBLE / (q0 + q1), 6) AS q1 FROM c",
)
def row_percentages(t):
    return stats.row_percentages(label_table(t), ["q0", "q1"], 6)


@query(
    "unpivot_long",
    PIVOT + "SELECT lang, 'q0' AS variable, q0 AS value FROM c UNION ALL SELECT lang, 'q1', q1 FROM c",
)
def unpivot_long(t):
    return stats.unpivot_long(label_table(t), ["lang"], ["q0", "q1"])


def user_days(t):
    """Distinct event types per user and day: sets over a small vocabulary, combined map-side."""
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("labels"))


USER_DAYS = "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type AS label FROM events) "


@query(
    "label_cooccurrence",
    USER_DAYS
    + """, p AS (SELECT a.label AS label_1, b.label AS label_2, count(*) AS n
                 FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.label <> b.label GROUP BY ALL)
         SELECT label_1, label_2, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM p""",
)
def label_cooccurrence(t):
    return stats.label_cooccurrence(user_days(t), "labels").withColumn("percent", F.round("percent", 6))


@query(
    "top_label_pairs",
    USER_DAYS
    + """SELECT a.label AS label_1, b.label AS label_2, count(*) AS n
         FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.label < b.label
         GROUP BY ALL ORDER BY n DESC, label_1, label_2 LIMIT 5""",
)
def top_label_pairs(t):
    return stats.top_label_pairs(user_days(t), "labels", 5)


@query("annotator_disagreement", ANNOTATIONS + "SELECT doc_id FROM a WHERE len(list_distinct(labels)) > 1")
def annotator_disagreement(t):
    return stats.annotator_disagreement(annotations(t), "labels").select("doc_id")


@query(
    "disagreeing_combinations",
    ANNOTATIONS + "SELECT DISTINCT array_to_string(list_sort(labels), '+') AS combination FROM a WHERE len(list_distinct(labels)) > 1",
)
def disagreeing_combinations(t):
    found = stats.disagreeing_combinations(annotations(t), "labels")
    return found.select(F.array_join("labels", "+").alias("combination"))


@query(
    "group_mean_list_len",
    "SELECT lang, round(avg(len(string_split(text, ' '))), 6) AS mean_len FROM documents GROUP BY lang",
)
def group_mean_list_len(t):
    rows = t.documents.select("lang", F.split("text", " ").alias("tokens"))
    return stats.group_mean_list_len(rows, "lang", "tokens").withColumn("mean_len", F.round("mean_len", 6))


@query(
    "coverage_ratio",
    """SELECT count(quality) AS annotated, count(*) AS total, round(count(quality) / count(*), 6) AS ratio
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def coverage_ratio(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return stats.coverage_ratio(joined, "quality").withColumn("ratio", F.round("ratio", 6))


@query(
    "min_max_mean_median",
    """WITH m AS (SELECT list_max(embedding)::DOUBLE AS v FROM embeddings)
       SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median FROM m""",
)
def min_max_mean_median(t):
    rows = t.embeddings.select(F.col("embedding").cast("array<double>").alias("scores"))
    return rounded(stats.min_max_mean_median(rows, "scores"), "min", "max", "mean", "median")


@query(
    "histogram",
    """WITH d AS (SELECT n_chars::DOUBLE AS v FROM documents WHERE n_chars <= (SELECT quantile_cont(n_chars, 0.95) FROM documents)),
            e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 9 AS w FROM d),
            b AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), 8) AS bin, count(*) AS n FROM d, e GROUP BY 1)
       SELECT r.bin, round(lo + r.bin * w, 6) AS left_edge, round(lo + (r.bin + 1) * w, 6) AS right_edge, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(9)) AS bin) r LEFT JOIN b ON r.bin = b.bin, e""",
)
def histogram(t):
    rows = filters.filter_quantile(t.documents.select("n_chars"), "n_chars", 0.95)
    return rounded(stats.histogram(rows, "n_chars", 9), "left_edge", "right_edge")


@query("largest_key", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1")
def largest_key(t):
    return stats.largest_key(t.events, "user_id")


@query(
    "counts_above",
    """SELECT p_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS proportion
       FROM part WHERE p_retailprice > 950 GROUP BY p_type""",
)
def counts_above(t):
    return rounded(stats.counts_above(t.part, "p_type", "p_retailprice", 950), "proportion")


@query("trial_leaderboard", "SELECT p_partkey, p_type, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def trial_leaderboard(t):
    return stats.trial_leaderboard(t.part.select("p_partkey", "p_type", "p_retailprice"), "p_retailprice", "p_partkey", 20)


@query(
    "best_per_study",
    """SELECT p_type, p_partkey, p_retailprice FROM part
       QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) = 1""",
)
def best_per_study(t):
    return stats.best_per_study(t.part.select("p_type", "p_partkey", "p_retailprice"), "p_type", "p_retailprice", "p_partkey")


@query(
    "cheapest_trial",
    """SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_retailprice >= 950
       ORDER BY p_size, p_retailprice DESC, p_partkey LIMIT 1""",
)
def cheapest_trial(t):
    trials = t.part.select("p_partkey", "p_size", "p_retailprice")
    return stats.cheapest_trial(trials, "p_retailprice", 950.0, "p_size", "p_partkey")


@query(
    "cost_estimate",
    "SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, count(*) AS items, round(count(*) * 0.002::DOUBLE, 6) AS cost FROM pages GROUP BY 1",
)
def cost_estimate(t):
    from curate.functions.urls import url_host

    rows = t.pages.select(url_host("url").alias("host"))
    return stats.cost_estimate(rows, "host", 0.002).withColumn("cost", F.round("cost", 6))


# ---- order, samples, splits


@query("top_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 5")
def top_rows(t):
    return sampling.top_rows(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 30, skip=5)


@query("head", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def head(t):
    return t.events.select("event_id", "event_type").orderBy("event_id").limit(1000)


@query("sample_n", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id) LIMIT 100")
def sample_n(t):
    return sampling.sample_n(t.documents.select("doc_id", "lang"), 100, 42, "doc_id")


@query("sample_fraction", "SELECT event_id FROM events WHERE substr(md5('42:' || event_id), 1, 8) < '40000000'")
def sample_fraction(t):
    return sampling.sample_fraction(t.events.select("event_id"), 0.25, 42, "event_id")


@query(
    "train_test_split",
    """SELECT doc_id, CASE WHEN substr(md5('1:' || doc_id), 1, 8) < '0ccccccd' THEN 'first'
         WHEN substr(md5('2:' || doc_id), 1, 8) < '79447c0a' THEN 'second' ELSE 'rest' END AS split FROM documents""",
)
def train_test_split(t):
    two = sampling.train_test_split(t.documents.select("doc_id"), {"first": 0.05, "rest": 0.95}, 1, "doc_id")
    rest = sampling.train_test_split(
        two.filter("split = 'rest'").drop("split"), {"second": 0.4737, "rest": 0.5263}, 2, "doc_id"
    )
    return two.filter("split = 'first'").unionByName(rest)


STRATIFIED = """WITH j AS (SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('42:' || doc_id)) AS rn,
            count(*) OVER (PARTITION BY lang, quality) AS size FROM j),
    s AS (SELECT doc_id, lang, quality, toxic, CASE WHEN rn <= floor(0.2 * size + 0.5) THEN 'test' ELSE 'train' END AS split FROM r) """


@query("stratified_split", STRATIFIED + "SELECT doc_id, lang, quality, toxic, split FROM s")
def stratified_split(t):
    return sampling.stratified_split(labelled(t), ["lang", "quality"], 0.2, 42, "doc_id")


@query(
    "split_report",
    STRATIFIED
    + """SELECT split, lang, count(*) AS n, round(100.0::DOUBLE * CAST(sum(toxic) AS BIGINT) / count(toxic), 6) AS percent_true,
           round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS percent_of_split
         FROM s GROUP BY split, lang""",
)
def split_report(t):
    report = sampling.split_report(stratified_split(t), "lang", "toxic")
    return rounded(report, "percent_true", "percent_of_split")


# ---- sets


@query(
    "union_typed",
    """SELECT 'customer' AS type, c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def union_typed(t):
    customers = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    suppliers = t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return sets.union_typed({"customer": customers, "supplier": suppliers})


@query("concat_batches", "SELECT doc_id, lang FROM documents")
def concat_batches(t):
    rows = t.documents.select("doc_id", "lang")
    return sets.concat_batches([rows.filter(F.col("lang") == v) for v in ("en", "fr", "de", "es")])
