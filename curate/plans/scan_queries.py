"""Queries on sources, sinks and keyed collections."""

from pyspark.sql import functions as F

from curate.operators.sampling import train_test_split
from curate.plans.registry import query
from curate.session import fresh_path, materialize
from curate.sources import collection, readers, writers


@query("scan_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_parquet(t):
    return readers.scan_parquet(t.spark, [f"{t.folder}/docum*.parquet"]).select("doc_id", "lang", "source", "n_chars")


@query("read_parquet_columns", "SELECT doc_id, source FROM documents")
def read_parquet_columns(t):
    return t.documents.select("doc_id", "source")


def documents_by_language(t, name):
    path = fresh_path(t.spark, name)
    writers.write_parquet(t.documents, path, ["lang"], rebalance=True)
    return path


@query("select_files", "SELECT DISTINCT 'lang=' || lang AS folder FROM documents WHERE lang <> 'de'")
def select_files(t):
    root = documents_by_language(t, "select-files")
    files = readers.select_files(t.spark, root, "lang=", ".parquet", ["lang=de", "removed"])
    return files.select(readers.folder_name("file", 2).alias("folder")).distinct()


@query(
    "sample_files",
    """SELECT doc_id, source FROM documents WHERE source IN
         (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('42:source=' || source) LIMIT 3)""",
)
def sample_files(t):
    root = fresh_path(t.spark, "sample-files")
    writers.write_parquet(t.documents.select("doc_id", "source"), root, ["source"], rebalance=True)
    files = readers.select_files(t.spark, root, suffix=".parquet")
    folders = files.select(readers.folder_name("file", 2).alias("folder")).distinct()
    chosen = readers.sample_files(folders, 3, seed=42, path="folder")
    parts = t.spark.read.option("basePath", root).parquet(*[f"{root}/{c}" for c in chosen])
    return parts.select("doc_id", "source")


@query("read_csv_schema", "SELECT c_custkey AS id, c_name AS meta FROM customer")
def read_csv_schema(t):
    path = fresh_path(t.spark, "inventory-csv")
    t.customer.select("c_custkey", "c_name").write.csv(path)
    return readers.read_csv_schema(t.spark, path, "id long, meta string")


@query(
    "read_csv_skip_bad",
    """SELECT p_partkey, p_type, p_size FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#5', 'Brand#7')""",
)
def read_csv_skip_bad(t):
    # Some brands are written with a wrong type, a missing field or a field too many.
    size = F.when(F.col("p_brand") == "Brand#3", "large").otherwise(F.col("p_size").cast("string"))
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_type", size)
    line = F.when(F.col("p_brand") == "Brand#5", F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_type"))\
        .when(F.col("p_brand") == "Brand#7", F.concat(line, F.lit("\textra"))).otherwise(line)
    path = fresh_path(t.spark, "damaged-tsv")
    t.part.select(line.alias("value")).write.text(path)
    return readers.read_csv_skip_bad(
        t.spark, path, "p_partkey long, p_type string, p_size int", header=False
    )


@query("read_json_columns", "SELECT event_id, event_type FROM events")
def read_json_columns(t):
    path = fresh_path(t.spark, "export-json")
    t.events.select("event_id", "event_type", "user_id", "props").write.json(path)
    return readers.read_json_columns(t.spark, path, "event_id long, event_type string", multi_line=False)


@query("label_from_path", "SELECT doc_id, lang AS label FROM documents")
def label_from_path(t):
    root = documents_by_language(t, "folders")
    return readers.label_from_path(t.spark.read.parquet(root).drop("lang")).select("doc_id", "label")


@query("write_parquet", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def write_parquet(t):
    root = documents_by_language(t, "sink")
    back = t.spark.read.parquet(root)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("materialize", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 500")
def materialize_query(t):
    return materialize(t.documents.select("doc_id", "lang", "n_chars").filter("n_chars > 500"))


@query("write_ids", "SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'de')")
def write_ids(t):
    path = fresh_path(t.spark, "good-ids")
    writers.write_ids(t.documents.filter(F.col("lang").isin("en", "de")), "doc_id", path)
    return t.spark.read.text(path).select(F.col("value").cast("long").alias("id"))


@query("write_csv", "SELECT page_id, url FROM pages")
def write_csv(t):
    path = fresh_path(t.spark, "csv")
    writers.write_csv(t.pages.select("page_id", "url"), path)
    return readers.read_csv_schema(t.spark, path, "page_id long, url string", header=True)


@query(
    "publish_dataset",
    """SELECT doc_id, CAST(quality AS BIGINT) AS quality,
         CASE WHEN substr(md5('7:' || doc_id), 1, 8) < 'cccccccd' THEN 'train' ELSE 'test' END AS split
       FROM labels""",
)
def publish_dataset(t):
    path = fresh_path(t.spark, "published")
    splits = train_test_split(t.labels, {"train": 0.8, "test": 0.2}, 7, "doc_id")
    older = splits.filter("quality = 0")
    writers.publish_dataset(older, path, version="2024-01-01")
    writers.publish_dataset(splits, path, casts={"quality": "long"}, version="2024-02-01")
    return writers.read_published(t.spark, path).select("doc_id", "quality", "split")


@query(
    "upsert_by_key",
    """WITH batch AS (
         SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P'
         UNION ALL
         SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F')
       SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM batch
       UNION ALL
       SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4)
       FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch)""",
)
def upsert_by_key(t):
    target = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    part = target.filter("o_orderstatus = 'P'")
    stale = part.withColumns({"o_totalprice": F.lit(0.0), "version": F.lit(1)})
    fresh = part.withColumns({"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("X"), "version": F.lit(2)})
    new = target.filter("o_orderstatus = 'F'").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "version": F.lit(1)})
    batch = stale.unionByName(fresh).unionByName(new)
    merged = collection.upsert_by_key(target, batch, "o_orderkey", "version")
    return merged.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("scroll_page", "SELECT vec_id, label FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 50")
def scroll_page(t):
    return collection.scroll_page(t.embeddings, "vec_id", 50, after=100, without=("embedding",))


@query(
    "collection_info",
    """SELECT count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
         CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM embeddings""",
)
def collection_info(t):
    return collection.collection_info(t.embeddings, "embedding")


# Orders after three batches: one changed range of keys, the same again with later and earlier versions, new keys at the end.
UPSERTED = """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders),
    e AS (SELECT max(o_orderkey) AS top, (max(o_orderkey) + min(o_orderkey)) // 2 AS mid, (max(o_orderkey) - min(o_orderkey)) // 100 AS step FROM o),
    u AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey >= mid AND o_orderkey < mid + step // 2 THEN o_totalprice + 3
                 WHEN o_orderkey >= mid AND o_orderkey < mid + step THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o, e
          UNION ALL SELECT top + 1 + o_orderkey, o_custkey, 0.5 FROM o, e WHERE o_orderkey < step) """


def upserted(t):
    """A collection of orders in about 40 ranges, after the three batches; the ranges that each rewrote."""
    rows = materialize(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))
    path = fresh_path(t.spark, "collection")
    low, top, n = rows.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count("*")).first()
    collection.write_collection(rows, path, "o_orderkey", -(-n // 40))
    mid, step = (top + low) // 2, (top - low) // 100
    changed = rows.filter((F.col("o_orderkey") >= mid) & (F.col("o_orderkey") < mid + step))
    again = rows.filter((F.col("o_orderkey") >= mid) & (F.col("o_orderkey") < mid + step // 2))
    fresh = rows.filter(F.col("o_orderkey") < step).select((F.col("o_orderkey") + top + 1).alias("o_orderkey"), "o_custkey", F.lit(0.5).alias("o_totalprice"))

    def version(batch, number, more):
        return batch.withColumns({"o_totalprice": F.col("o_totalprice") + more, "version": F.lit(number)})

    batches = [version(changed, 1, 1), version(again, 3, 3).unionByName(version(again, 2, 2)), version(fresh, 1, 0)]
    return path, [collection.upsert_collection(t.spark, path, b, "o_orderkey", "version") for b in batches]


@query("upsert_collection", UPSERTED + "SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice FROM u")
def upsert_collection(t):
    path, _ = upserted(t)
    found = collection.read_collection(t.spark, path)
    return found.select("o_orderkey", "o_custkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("collection_page", UPSERTED + "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM u, e WHERE o_orderkey > mid - 20 ORDER BY o_orderkey LIMIT 100")
def collection_page(t):
    path, _ = upserted(t)
    low, top = t.orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    page = collection.collection_page(t.spark, path, "o_orderkey", 100, (top + low) // 2 - 20, without=("o_custkey",))
    return page.withColumn("o_totalprice", F.round("o_totalprice", 4))
