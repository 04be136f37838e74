"""Sinks: Parquet, CSV, id lists and published dataset versions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(
    rows: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Sink a plan into Parquet files.

    With many values in ``partition_by`` every task would write a small file for each; then
    ``rebalance`` first brings the rows of a folder together, and Spark splits the shuffle
    partition of a folder that is far larger than others. A few values need no shuffle.
    """
    if partition_by and rebalance:
        rows = rows.hint("rebalance", *partition_by)
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_ids(rows: DataFrame, id_column: str, path: str, mode: str = "errorifexists") -> None:
    """Text files with one id per line."""
    rows.select(F.col(id_column).cast("string").alias("value")).write.mode(mode).text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def publish_dataset(
    rows: DataFrame,
    path: str,
    split_column: str = "split",
    casts: dict[str, str] | None = None,
    version: str | None = None,
) -> str:
    """Write a finished dataset as a date-named version with one folder per split; returns the version.

    The version is entered into the list of versions only after its data is complete, so a reader
    never sees half of one. Each run writes a folder of its own: publishing a version again, also after
    a run that broke off, replaces it for readers.
    """
    version = version or date.today().isoformat()
    folder = f"version={version}/run={datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    rows = rows.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})
    write_parquet(rows, f"{path}/data/{folder}", [split_column])
    entry = rows.sparkSession.createDataFrame([(version, folder)], "version string, folder string")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def published_versions(spark: SparkSession, path: str) -> DataFrame:
    """All complete versions below ``path``."""
    return _entries(spark, path).select("version").distinct()


def _entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version string, folder string").parquet(f"{path}/versions")


def read_published(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A published version, by default the latest."""
    if version is None:
        version = published_versions(spark, path).agg(F.max("version")).first()[0]
    # Folder names of a version sort by the time of their run.
    folder = _entries(spark, path).filter(F.col("version") == version).agg(F.max("folder")).first()[0]
    return spark.read.parquet(f"{path}/data/{folder}")
