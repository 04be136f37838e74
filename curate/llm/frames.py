"""Helpers shared by the operators: normal input rows, intermediate tables, Arrow output."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.session import materialize

#: Stands for a null doc_id inside the operators, so that such rows are kept like all others.
NO_ID = -(2**63)


def id_in(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID).cast("long")).alias(column)


def id_out(column: str = "doc_id") -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID).cast("long")).alias(column)


def plain(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of every row, and the named columns; all others are left behind."""
    return docs.select(id_in(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


#: Size of a bitmap of hashed ids (4 MB). More ids than this only let more rows through.
BITS = 1 << 25


def bit_of(column: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def bitmap_of(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """A bitmap of hashed ids in pieces of 4 KB, ``k, bits``: at most ``BITS / 32768`` rows however many ids."""
    at = ids.select((bit_of(column) + 1).alias("at"))
    return table(at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))


def maybe_in(rows: DataFrame, bitmap: DataFrame, column: str = "doc_id") -> DataFrame:
    """``rows`` with a flag ``_maybe``: false where the id is surely not among those of the bitmap.

    Lets wide rows be told apart in the scan, so that only those that may be concerned are shuffled.
    """
    at = bit_of(column) + 1
    put = rows.withColumns({"_piece": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)})
    met = put.join(F.broadcast(bitmap), F.col("_piece") == F.col("k"), "left")  # of fixed size
    hit = F.expr("shiftright(cast(conv(hex(substring(bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1") == 1
    return met.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_piece", "_bit", "k", "bits")


#: Bytes of an Arrow batch that a Python worker gets at once: twice that is held on both sides.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes as well as in rows, for jobs in which Python workers live on between stages.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` for the session; results do not depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(rows: DataFrame) -> DataFrame:
    """Write to the shared folder and scan the result."""
    return materialize(rows)


def release_memory() -> None:
    """Give memory that earlier tasks of this Python worker freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def arrays_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
