"""Queries on search by trained cells and late interaction."""

from pyspark.sql import functions as F

from curate.functions.vectors import doubles
from curate.operators import cells, late
from curate.plans.registry import query
from curate.plans.table_queries import rounded
from curate.session import dealt, materialize

# Ten vectors around each: an offset of at most 0.02 per number that any engine can repeat.
CLUSTERED = """WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(10)) AS copy FROM embeddings),
    c AS (SELECT vec_id * 10 + copy AS id, vec_id, copy, list_transform(e, lambda x, i:
            x + (((vec_id * 7919 + copy * 104729 + i * 15485863 + copy * i * 31337) % 2001) - 1000) / 1000.0::DOUBLE * 0.02::DOUBLE) AS e FROM g)"""


def clustered(t):
    wide = dealt(t.embeddings.select("vec_id", "embedding"))
    wide = wide.select("vec_id", doubles("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy"))

    def moved(x, i):
        i = i.cast("long") + 1
        step = F.col("vec_id") * 7919 + F.col("copy") * 104729 + i * 15485863 + F.col("copy") * i * 31337
        return x + ((step % 2001) - 1000) / 1000.0 * 0.02

    return wide.select((F.col("vec_id") * 10 + F.col("copy")).alias("id"), "vec_id", "copy", F.transform("e", moved).alias("e"))


def cells_setting(t):
    """Clustered vectors, a query for every hundredth, and their index."""
    rows = materialize(clustered(t))
    model = cells.train_cells(rows, "id", "e")
    return rows, rows.filter("id % 100 = 0"), cells.index_cells(rows, "id", "e", model), model


@query("knn_join_cells")
def knn_join_cells(t):
    rows, asked, lists, model = cells_setting(t)
    return rounded(cells.knn_join_cells(asked, rows, lists, model, 5, "id", "e", probes=4, exclude_self=True), "distance")


@query(
    "knn_join_cells_recall",
    CLUSTERED + "SELECT count(*) FILTER (id % 100 = 0) AS queries, count(*) AS rows, true AS recall_reached, true AS pairs_bounded FROM c",
)
def knn_join_cells_recall(t):
    # Recall of the 5 nearest against the exact join, and compared pairs against all pairs.
    rows, asked, lists, model = cells_setting(t)
    sizes = cells.list_sizes(lists)
    near = materialize(cells.knn_join_cells(asked, rows, lists, model, 5, "id", "e", probes=4, exclude_self=True, sizes=sizes))
    true = cells.knn_join_exact(asked, rows, near, model, 5, "id", "e", exclude_self=True, sizes=sizes).select("query_id", "row_id")
    counts = rows.agg(F.count_if(F.col("id") % 100 == 0).alias("queries"), F.count("*").alias("rows"))
    found = true.join(near, ["query_id", "row_id"], "left_semi").agg(F.count("*")).scalar()
    pairs = cells.probed_pairs(asked, "id", "e", model, sizes, 6, probes=4)
    return counts.select(
        "queries", "rows", (found >= F.lit(0.9 * 5) * F.col("queries")).alias("recall_reached"),
        (pairs <= F.lit(0.1) * F.col("queries") * F.col("rows")).alias("pairs_bounded"),
    )


@query(
    "maxsim_join",
    CLUSTERED
    + """, q AS (SELECT vec_id // 25 AS query, e FROM c WHERE vec_id % 25 < 3 AND copy = 0),
         s AS (SELECT query, q.e AS qe, c.vec_id AS document, max(list_dot_product(c.e, q.e)) AS best FROM q, c GROUP BY ALL),
         t AS (SELECT query, document, sum(best) AS score FROM s GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM t)
         SELECT query, document, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def maxsim_join(t):
    # Documents of ten vectors each; queries of three vectors, each near another document.
    rows = materialize(clustered(t))
    asked = rows.filter("vec_id % 25 < 3 AND copy = 0").withColumn("query", F.floor(F.col("vec_id") / 25))
    n = rows.count()
    sample = cells.sample_of(cells.prepared(rows, "id", "e", "l2"), n, cells.SAMPLE_ROWS, 42)
    centers = cells.train_centers(sample, max(1, int(6 * n**0.5)))
    return rounded(late.maxsim_join(asked, rows, 10, "query", "vec_id", "e", centers), "score")
