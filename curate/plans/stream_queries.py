"""Queries on stateful streams."""

from pyspark.sql import functions as F

from curate.plans.registry import query
from curate.session import fresh_path
from curate.streaming import state, streams

# Versions of customers over two runs: late, repeated and higher ones.
VERSIONS = """WITH v AS (SELECT c_custkey AS k, c_acctbal AS v, 1 AS version, 1 AS run FROM customer
    UNION ALL SELECT c_custkey, c_acctbal + 3, 3, 1 FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, c_acctbal + 2, 2, 2 FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, c_acctbal + 3, 3, 2 FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, c_acctbal + 4, 4, 2 FROM customer WHERE c_custkey % 5 = 0),
    r AS (SELECT k, run, max(version) AS version, max_by(v, version) AS v FROM v GROUP BY k, run),
    f AS (SELECT *, max(version) OVER (PARTITION BY k ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) """


@query(
    "stream_latest_changes",
    VERSIONS + """SELECT k, CAST(version AS BIGINT) AS version, round(v, 4) AS v, row_number() OVER (PARTITION BY k ORDER BY run) AS changes
                  FROM f WHERE before IS NULL OR version > before""",
)
def stream_latest_changes(t):
    source, out = fresh_path(t.spark, "versions"), fresh_path(t.spark, "latest")
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    runs = [((1, 1), (3, 3)), ((2, 2), (3, 3), (4, 5))]
    for run in runs:
        for number, every in run:
            rows = base.filter(F.col("k") % every == 0).select("k", (F.col("v") + (number if number > 1 else 0)).alias("v"), F.lit(number).cast("long").alias("version"))
            rows.write.mode("append").parquet(source)
        # The second run goes on from the first one's checkpoint.
        stream = streams.stream_corpus(t.spark, source, rows.schema)
        streams.stream_to_parquet(state.latest_changes(stream, "k", "version"), out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.parquet(out).select("k", "version", F.round("v", 4).alias("v"), "changes")
