"""Queries on nested model output, generators over groups and frequent pairs."""

from pyspark.sql import functions as F

from curate.functions import variants
from curate.operators import pairs, sessions
from curate.plans.registry import query

#: What a card should hold.
CARD = {"$.id": "BIGINT", "$.lang": "STRING", "$.about.source": "STRING", "$.props.k": "BIGINT", "$.sizes": "ARRAY"}


def cards(t):
    """Answers of a model that hold a record: prose with braces, a nested object with escapes, some fields missing or of another type."""
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit('"'), "doc_id", F.lit('"'))).otherwise(F.col("doc_id").cast("string"))
    lang = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit('"lang": "'), "lang", F.lit('", '))).otherwise(F.lit(""))
    note = F.lit(r'"note": "a \"quoted\" } brace and a \\"')
    close = F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.lit("}"))
    body = F.concat(
        F.lit('{"id": '), name, F.lit(", "), lang, F.lit('"about": {"source": "'), "source", F.lit('", '), note, F.lit('}, "props": '), "props",
        F.lit(', "sizes": ['), F.col("n_chars").cast("string"), F.lit(", 2]"), close,
    )
    joined = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.events.select(F.col("event_id").alias("doc_id"), "props"), "doc_id")
    return joined.select("doc_id", F.concat(F.lit("Sure {as asked}: "), body, F.lit(" -- {done")).alias("answer"))


@query(
    "extract_nested_record",
    """SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 13 <> 0 THEN lang END AS lang,
         CASE WHEN doc_id % 13 <> 0 THEN source END AS source, CASE WHEN doc_id % 13 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
         CASE WHEN doc_id % 13 <> 0 THEN n_chars END AS size
       FROM documents JOIN events ON event_id = doc_id""",
)
def extract_nested_record(t):
    record = cards(t).select("doc_id", variants.parse_record("answer").alias("v"))
    paths = {"id": ("$.id", "bigint"), "lang": ("$.lang", "string"), "source": ("$.about.source", "string"), "k": ("$.props.k", "bigint"), "size": ("$.sizes[0]", "bigint")}
    return record.select("doc_id", *[variants.field("v", path, kind).alias(n) for n, (path, kind) in paths.items()])


@query(
    "nested_violations",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '$.id $.lang $.about.source $.props.k $.sizes'
         ELSE trim(CASE WHEN doc_id % 11 = 0 THEN '$.id ' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '$.lang' ELSE '' END) END AS broken
       FROM documents JOIN events ON event_id = doc_id""",
)
def nested_violations(t):
    record = cards(t).select("doc_id", variants.parse_record("answer").alias("v"))
    return record.select("doc_id", F.array_join(variants.violations("v", CARD), " ").alias("broken"))


@query(
    "nested_schema",
    """SELECT count(*) AS records, 'OBJECT<about: OBJECT<note: STRING, source: STRING>, id: BIGINT, lang: STRING, props: OBJECT<k: BIGINT>, sizes: ARRAY<BIGINT>>'
         AS schema FROM documents JOIN events ON event_id = doc_id WHERE doc_id % 13 <> 0 AND doc_id % 11 <> 0""",
)
def nested_schema(t):
    record = cards(t).filter("doc_id % 11 <> 0").select(variants.parse_record("answer").alias("v"))
    record = record.filter(variants.field("v", "$.id", "bigint").isNotNull())
    return record.agg(F.count("*").alias("records"), F.schema_of_variant_agg("v").alias("schema"))


@query(
    "user_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
       SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session HAVING count(*) >= 2""",
)
def user_sessions(t):
    found = sessions.sessions(t.events, "user_id", "ts", 6 * 3600, least=2)
    return found.select("user_id", F.col("start").alias("first"), F.col("end").alias("last"), "n")


@query(
    "frequent_pairs",
    """WITH b AS (SELECT DISTINCT o_custkey, p_name || ' ' || p_brand AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
       SELECT x.item AS item_1, y.item AS item_2, count(*) AS n FROM b x JOIN b y ON x.o_custkey = y.o_custkey AND x.item < y.item
       GROUP BY ALL HAVING count(*) >= 4""",
)
def frequent_pairs(t):
    bought = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    lists = bought.groupBy("o_custkey").agg(F.collect_list(F.concat_ws(" ", "p_name", "p_brand")).alias("items"))
    return pairs.frequent_pairs(lists, "items", 4)
