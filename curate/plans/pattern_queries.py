"""Queries on tables of literals: keywords anywhere in a text, prefixes of URLs."""

from pyspark.sql import functions as F

from curate.operators import patterns
from curate.plans.registry import query

# Distinct words of the corpus, the first along their md5.
WORDS = """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents),
    k AS (SELECT word FROM w WHERE length(word) >= {least} ORDER BY md5(word), word LIMIT {n}) """


def words(t, least, n):
    split = t.documents.select(F.explode(F.split("text", " ")).alias("word")).filter(F.char_length("word") >= least).distinct()
    return split.orderBy(F.md5("word"), "word").limit(n)


@query("keyword_hits", WORDS.format(least=6, n=1000) + "SELECT doc_id, word, CAST(strpos(text, word) AS BIGINT) AS first FROM documents, k WHERE contains(text, word)")
def keyword_hits(t):
    hits = patterns.literal_hits(t.documents.select("doc_id", "text"), "doc_id", "text", words(t, 6, 1000), "word")
    return hits.groupBy("doc_id", F.col("literal").alias("word")).agg(F.min("position").alias("first"))


@query(
    "filter_any_keyword_table",
    WORDS.format(least=14, n=1000) + "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM k WHERE contains(text, word) OR contains(source, word))",
)
def filter_any_keyword_table(t):
    return patterns.filter_any_literal(t.documents, ["text", "source"], words(t, 14, 1000), "word").select("doc_id", "lang")


SITES = r"""WITH s AS (SELECT regexp_extract(url, '^https?://[^/]+') AS site FROM pages WHERE page_id % 3 = 0
                      UNION SELECT regexp_extract(url, '^https?://[^/]+/[^/?#]+') FROM pages WHERE page_id % 2 = 0) """


def sites(t):
    host = t.pages.filter("page_id % 3 = 0").select(F.regexp_extract("url", "^https?://[^/]+", 0).alias("site"))
    return host.unionByName(t.pages.filter("page_id % 2 = 0").select(F.regexp_extract("url", "^https?://[^/]+/[^/?#]+", 0).alias("site")))


@query(
    "longest_prefix_url",
    SITES + "SELECT page_id, max_by(site, length(site)) AS prefix FROM pages LEFT JOIN s ON site <> '' AND starts_with(url, site) GROUP BY page_id",
)
def longest_prefix_url(t):
    return patterns.longest_prefix(t.pages.select("page_id", "url"), "url", sites(t), "site").select("page_id", "prefix")
