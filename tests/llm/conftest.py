import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.dirname(os.path.abspath(__file__))]

from pyspark.sql.types import LongType, StringType, StructField, StructType  # noqa: E402

#: Columns that clash with names used inside the operators.
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()), StructField("score", StringType()), StructField("n", LongType()), StructField("size", StringType()),
    StructField("digest", StringType()), StructField("rep", StringType()), StructField("block", StringType()),
    *[StructField(n, StringType()) for n in ("k", "bits", "_id", "_source", "_piece", "_bit", "_maybe", "row", "id", "of", "text_key", "component", "_doc", "_copies", "key", "group")],
])


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source), with further columns."""

    def build(rows, parts=3):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or ""), "x", 7, None, "y", "z", "w", *["v"] * 16) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build

