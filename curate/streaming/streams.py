"""Structured Streaming: bounded-memory consumption, resumable jobs, streaming upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from curate.operators.stats import drop_duplicates
from curate.sources.writers import publish_dataset, published_versions, read_published


def stream_corpus(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream; ``max_files`` bounds what one batch reads."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_to_parquet(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet folder exactly once, then stop when the input is used up."""
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def incremental_process(
    spark: SparkSession,
    source: str,
    schema: StructType,
    out: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    max_files: int | None = None,
) -> StreamingQuery:
    """Process the files that no earlier run with this checkpoint has completed.

    Finished batches are visible at once; after a crash the next run goes on with the first
    unfinished batch and repeats nothing that was committed.
    """
    return stream_to_parquet(transform(stream_corpus(spark, source, schema, max_files)), out, checkpoint)


class _EnoughBatches(Exception):
    pass


def first_batches(
    rows: DataFrame, handle: Callable[[DataFrame, int], None], steps: int, checkpoint: str
) -> list[int]:
    """Hand the next ``steps`` batches of a stream to ``handle``, then stop (a training loop's max steps).

    Returns the numbers of the batches. The batch after the last is refused before it is
    committed, so that a later run with the same checkpoint goes on with it.
    """
    handled: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        if len(handled) == steps:
            raise _EnoughBatches
        handle(batch, number)
        handled.append(number)

    query = (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if len(handled) < steps:
            raise
    return handled


def stream_upsert(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append every batch of changes to a change log, one folder per batch.

    The folder name is the batch number and a repeated batch overwrites its own folder, so a
    retry changes nothing. Nothing already written is rewritten; ``read_upserted`` resolves keys.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_upserted(spark: SparkSession, target: str, key: str, version: str, compacted: str | None = None) -> DataFrame:
    """Current state of a streamed collection: the highest version wins, then the latest batch.

    With ``compacted``, the folder of ``compact_upserted``, only its latest state and the batches after
    it are read.
    """
    log = spark.read.parquet(target)
    if compacted is not None:
        upto, state = _latest_state(spark, compacted)
        log = state.unionByName(log.filter(F.col("batch") > upto).withColumn("batch", F.col("batch").cast("long")))
    return drop_duplicates(log, [key], [version, "batch"], keep="last").drop("batch")


def _latest_state(spark: SparkSession, compacted: str) -> tuple[int, DataFrame]:
    upto = int(published_versions(spark, compacted).agg(F.max(F.col("version").cast("long"))).first()[0])
    return upto, read_published(spark, compacted, str(upto)).drop("split").withColumn("batch", F.lit(upto).cast("long"))


def compact_upserted(spark: SparkSession, target: str, key: str, version: str, compacted: str, before: str | None = None) -> int:
    """Write the state of a streamed collection up to its last batch as a new published version below ``compacted``.

    Returns that batch number. ``before`` names the folder of earlier compactions to start from, if there
    are any. The log stays as it is: batches up to the returned number may be removed.
    """
    upto = int(spark.read.parquet(target).agg(F.max(F.col("batch").cast("long"))).first()[0])
    state = read_upserted(spark, target, key, version, before)
    publish_dataset(state.withColumn("split", F.lit("state")), compacted, version=str(upto))
    return upto


def stream_filter_count(rows: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    """Count of a filtered scan in bounded memory; every Spark aggregate over a scan is that."""
    return rows.filter(predicate).agg(F.count("*").alias(name))
