"""Queries on column functions: text, URLs, lists, labels, vectors."""

from pyspark.sql import functions as F

from curate.functions import labels, records, text, urls, vectors
from curate.operators import filters
from curate.operators.ordering import row_index
from curate.plans.registry import query


@query(
    "extract_year",
    "SELECT o_orderkey, nullif(regexp_extract('DUMP-' || CAST(o_orderdate AS VARCHAR), '([0-9]{4})', 1), '') AS year FROM orders",
)
def extract_year(t):
    dump = F.concat(F.lit("DUMP-"), F.col("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", text.extract_year(dump).alias("year"))


# Hosts under suffixes of every kind, one per page, and what must be found.
SUFFIX_CASES = [
    ("www.gla.ac.uk", "ac.uk"), ("louvre.gouv.fr", "gouv.fr"), ("shop.example.xyz", "xyz"), ("a.b.unknownsuffix", "unknownsuffix"),
    ("192.168.0.1", None), ("x.y.kawasaki.jp", "y.kawasaki.jp"), ("city.kawasaki.jp", "kawasaki.jp"), ("bad host.com", None),
]


@query(
    "url_tld_rules",
    "SELECT page_id, CASE page_id % 8 "
    + " ".join(f"WHEN {i} THEN {'NULL' if s is None else repr(s)}" for i, (_, s) in enumerate(SUFFIX_CASES))
    + " END AS tld FROM pages",
)
def url_tld_rules(t):
    hosts = F.array(*[F.lit(h) for h, _ in SUFFIX_CASES])
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1)
    built = F.concat(F.lit("http://"), F.get(hosts, (F.col("page_id") % 8).cast("int")), path)
    rules = t.spark.createDataFrame([(r,) for r in urls.RULES], "rule string")
    return urls.url_tld(t.pages.select("page_id", built.alias("url")), "url", rules=rules).select("page_id", "tld")


@query(
    "url_tld",
    """SELECT page_id, regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '([a-z]+)$', 1) AS tld
       FROM pages""",
)
def url_tld(t):
    return urls.url_tld(t.pages.select("page_id", "url"), "url").select("page_id", "tld")


@query(
    "url_parts",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme,
                    string_split(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '.') AS p FROM pages)
       SELECT page_id, scheme, p[1] AS url1, p[2] AS url2, p[3] AS url3, p[4] AS url4 FROM h""",
)
def url_parts(t):
    return urls.url_parts(t.pages.select("page_id", "url"), "url", 4).drop("url")


@query("prompt_concat", "SELECT p_partkey, 'TITLE: ' || p_name || ' TYPE: ' || p_type AS prompt FROM part")
def prompt_concat(t):
    return t.part.select("p_partkey", F.concat(F.lit("TITLE: "), "p_name", F.lit(" TYPE: "), "p_type").alias("prompt"))


@query("len_chars", "SELECT doc_id, length(text) AS n FROM documents")
def len_chars(t):
    return t.documents.select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("len_bytes", "SELECT doc_id, strlen(text) AS n FROM documents")
def len_bytes(t):
    return t.documents.select("doc_id", F.octet_length("text").cast("long").alias("n"))


@query("contains_regex", "SELECT page_id, regexp_matches(url, 'example.(org|net)/') AS found FROM pages")
def contains_regex(t):
    return t.pages.select("page_id", filters.contains_regex("url", "example.(org|net)/").alias("found"))


@query("contains_literal", "SELECT doc_id, contains(text, '.') AS found FROM documents")
def contains_literal(t):
    return t.documents.select("doc_id", F.col("text").contains(".").alias("found"))


@query(
    "any_token_startswith",
    "SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'b'))) > 0",
)
def any_token_startswith(t):
    return t.part.filter(filters.any_token_startswith("p_name", " ", "b")).select("p_partkey", "p_name")


@query("split_words", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS words FROM documents")
def split_words(t):
    return t.documents.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("words"))


@query("lower_text", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def lower_text(t):
    return t.documents.select("doc_id", F.md5(F.lower("text")).alias("digest"))


@query(
    "path_tail",
    """WITH p AS (SELECT page_id, string_split(url, '/') AS a FROM pages)
       SELECT page_id, array_to_string(a[greatest(len(a) - 1, 1):len(a)], '/') AS tail FROM p""",
)
def path_tail(t):
    return t.pages.select("page_id", text.path_tail("url", 2).alias("tail"))


def annotations(t):
    """Label lists of two annotators per document, with agreement and disagreement."""
    value = F.when(F.col("quality") == 1, "useful").otherwise("none")
    problem = F.when(F.col("toxic") == 1, "problematic").otherwise("none")
    return t.labels.select("doc_id", F.array(value, problem).alias("labels"))


ANNOTATIONS = """WITH a AS (SELECT doc_id, [CASE WHEN quality = 1 THEN 'useful' ELSE 'none' END,
                              CASE WHEN toxic = 1 THEN 'problematic' ELSE 'none' END] AS labels FROM labels) """


@query("list_len", ANNOTATIONS + "SELECT doc_id, CAST(len(labels) AS INTEGER) AS n FROM a")
def list_len(t):
    return annotations(t).select("doc_id", F.size("labels").alias("n"))


@query("list_first", ANNOTATIONS + "SELECT doc_id, labels[1] AS first FROM a")
def list_first(t):
    return annotations(t).select("doc_id", F.get("labels", F.lit(0)).alias("first"))


@query("list_sort", ANNOTATIONS + "SELECT doc_id, array_to_string(list_sort(labels), '+') AS sorted FROM a")
def list_sort(t):
    return annotations(t).select("doc_id", F.array_join(F.array_sort("labels"), "+").alias("sorted"))


@query("list_unique", ANNOTATIONS + "SELECT doc_id, array_to_string(list_sort(list_distinct(labels)), '+') AS labels FROM a")
def list_unique(t):
    return annotations(t).select("doc_id", F.array_join(F.array_sort(F.array_distinct("labels")), "+").alias("labels"))


@query("join_list", ANNOTATIONS + "SELECT doc_id, array_to_string(labels, ' ') AS joined FROM a")
def join_list(t):
    return annotations(t).select("doc_id", F.array_join("labels", " ").alias("joined"))


@query(
    "parse_datetime",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders",
)
def parse_datetime(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    parsed = t.orders.select("o_orderkey", F.try_to_timestamp(iso).alias("ts"))
    return parsed.select("o_orderkey", F.year("ts").alias("year"), F.month("ts").alias("month"))


@query("year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def year(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query(
    "cast_columns",
    """SELECT doc_id, CAST(quality = 1 AS INTEGER) AS as_int, CAST(toxic = 1 AS VARCHAR) AS as_string,
         TRY_CAST(CASE WHEN quality = 1 THEN CAST(doc_id AS VARCHAR) ELSE 'x' END AS BIGINT) AS as_long FROM labels""",
)
def cast_columns(t):
    raw = F.when(F.col("quality") == 1, F.col("doc_id").cast("string")).otherwise("x")
    return t.labels.select(
        "doc_id",
        (F.col("quality") == 1).cast("int").alias("as_int"),
        (F.col("toxic") == 1).cast("string").alias("as_string"),
        raw.try_cast("long").alias("as_long"),
    )


@query(
    "encode_labels",
    """SELECT doc_id, lang, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 WHEN 'de' THEN 2 END AS label_id FROM documents""",
)
def encode_labels(t):
    return labels.encode_labels(t.documents.select("doc_id", "lang"), "lang", ["fr", "en", "de"])


@query(
    "decode_labels",
    """SELECT vec_id, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS name FROM embeddings""",
)
def decode_labels(t):
    keys = t.embeddings.select("vec_id", F.col("label").cast("string").alias("key"))
    return labels.decode_labels(keys, "key", ["zero", "one", "two"], "name").select("vec_id", "name")


@query("rename_drop", "SELECT doc_id AS id, lang AS language FROM documents")
def rename_drop(t):
    return t.documents.withColumnsRenamed({"doc_id": "id", "lang": "language"}).select("id", "language")


@query("truncate_text", "SELECT doc_id, substr(text, 1, 1000) AS shown FROM documents")
def truncate_text(t):
    return t.documents.select("doc_id", F.substring("text", 1, 1000).alias("shown"))


@query("round_to", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 2) AS price FROM lineitem")
def round_to(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 2).alias("price"))


@query(
    "normalize_instruction",
    r"""SELECT doc_id, md5(rtrim(trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' '), ':')) AS digest FROM documents""",
)
def normalize_instruction(t):
    return t.documents.select("doc_id", F.md5(text.normalize_instruction("text")).alias("digest"))


@query("append_token", "SELECT doc_id, md5(text || '<|end|>') AS digest FROM documents")
def append_token(t):
    return t.documents.select("doc_id", F.md5(F.concat("text", F.lit("<|end|>"))).alias("digest"))


@query("hub_url", "SELECT doc_id, 'https://data.example.org/' || source || '/' || lang || '/' || doc_id || '.txt' AS url FROM documents")
def hub_url(t):
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.documents.select("doc_id", F.concat_ws("/", F.lit("https://data.example.org"), "source", "lang", file).alias("url"))


@query(
    "split_front_matter",
    """SELECT doc_id, CASE WHEN lang <> 'de' THEN 'language: ' || lang || chr(10) || 'source: ' || source END AS front_matter,
         md5(text) AS body_digest FROM documents""",
)
def split_front_matter(t):
    header = F.concat(F.lit("---\nlanguage: "), "lang", F.lit("\nsource: "), "source", F.lit("\n---\n"))
    card = F.when(F.col("lang") != "de", F.concat(header, "text")).otherwise(F.col("text"))
    cards = text.split_front_matter(t.documents.select("doc_id", card.alias("card")), "card")
    return cards.select("doc_id", "front_matter", F.md5("body").alias("body_digest"))


@query("payload_struct", """SELECT c_custkey, to_json({'c_name': c_name, 'c_mktsegment': c_mktsegment})::VARCHAR AS payload FROM customer""")
def payload_struct(t):
    points = t.customer.select("c_custkey", F.array("c_acctbal").alias("vector"), "c_name", "c_mktsegment")
    return vectors.payload_struct(points, "vector", "c_custkey").select("c_custkey", F.to_json("payload").alias("payload"))


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS row_index FROM documents")
def row_index_query(t):
    return row_index(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"]).select("doc_id", "row_index")


@query(
    "has_nested_value",
    """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the '))) > 0 AS found FROM documents""",
)
def has_nested_value(t):
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line")))
    files = t.documents.select("doc_id", lines.alias("files"))
    return files.select("doc_id", records.has_nested_value("files", "line", "the ").alias("found"))


@query(
    "metadata_state",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'No card data' WHEN quality = 0 THEN 'false' WHEN toxic = 0 THEN 'true' END AS state
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def metadata_state(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    # No value list for quality 0, an empty one for toxic rows, else the language.
    languages = F.when(F.col("quality") == 0, F.lit(None)).when(
        F.col("toxic") == 1, F.array().cast("array<string>")
    ).otherwise(F.array("lang"))
    return joined.select("doc_id", records.metadata_state("quality", languages).alias("state"))


@query(
    "is_typed_tag",
    """SELECT event_id, contains(CASE WHEN value > 10 THEN event_type || ':' || user_id ELSE event_type END, ':') AS typed FROM events""",
)
def is_typed_tag(t):
    return t.events.select("event_id", tag().contains(":").alias("typed"))


def tag():
    typed = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    return F.when(F.col("value") > 10, typed).otherwise(F.col("event_type"))


SOFTMAX = """WITH s AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
                  p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s) """


@query(
    "softmax_top",
    SOFTMAX
    + """SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS top_index,
           ['a', 'b', 'c'][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS confidence FROM p""",
)
def softmax_top(t):
    scores = t.embeddings.select("vec_id", F.slice("embedding", 1, 4).alias("scores"))
    top = vectors.softmax_top(scores, "scores", ["a", "b", "c"])
    return top.select("vec_id", "top_index", "label", F.round("confidence", 6).alias("confidence"))


@query(
    "sigmoid_labels",
    """WITH s AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: 1 / (1 + exp(-(x::DOUBLE)))) AS p FROM embeddings)
       SELECT vec_id, concat_ws(',', CASE WHEN p[1] >= 0.52 THEN 'a' END, CASE WHEN p[2] >= 0.52 THEN 'b' END,
         CASE WHEN p[3] >= 0.52 THEN 'c' END) AS labels FROM s""",
)
def sigmoid_labels(t):
    scores = t.embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("scores"))
    labelled = vectors.sigmoid_labels(scores, "scores", ["a", "b", "c"], 0.52)
    return labelled.select("vec_id", F.array_join("labels", ",").alias("labels"))


@query("reward_length", "SELECT conv_id, turn, -abs(20 - length(text)) AS reward FROM conversations")
def reward_length(t):
    return t.conversations.select("conv_id", "turn", (-F.abs(F.lit(20) - F.char_length("text").cast("long"))).alias("reward"))


@query("reward_exact", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS reward FROM conversations")
def reward_exact(t):
    return t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(0).alias("reward"))


@query(
    "prefix_levels",
    """WITH l AS (SELECT p_brand, unnest(range(1, length(p_brand) + 1)) AS level FROM part)
       SELECT CAST(level AS INTEGER) AS level, substr(p_brand, 1, level) AS prefix, count(*) AS n FROM l GROUP BY ALL""",
)
def prefix_levels(t):
    levels = text.explode_prefixes(t.part.select("p_brand"), "p_brand")
    return levels.groupBy("level", "prefix").agg(F.count("*").alias("n"))
