"""Readers: Parquet, CSV, JSON and file listings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curate.operators.ordering import seeded_hash


def scan_parquet(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Lazy scan of files, folders or globs."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(*paths)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder with path, size and time; no content is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listing.select("path", "length", "modificationTime")


def select_files(
    spark: SparkSession, root: str, contains: str = "", suffix: str = "", excludes: Sequence[str] = ()
) -> DataFrame:
    """Files below ``root`` by substring, suffix and forbidden substrings; dot-files are left out.

    The tests look only at the part of the path below ``root``.
    """
    # Listings may spell the scheme differently from the root (file:/x, file:///x).
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "/", root).rstrip("/") + "/"
    below = F.substr("path", F.locate(folder, F.col("path")) + F.lit(len(folder)))
    files = list_files(spark, root).withColumn("file", below)
    files = files.filter(~F.col("file").rlike(r"(^|/)\."))
    files = files.filter(F.col("file").contains(contains) & F.col("file").endswith(suffix))
    for word in excludes:
        files = files.filter(~F.col("file").contains(word))
    return files


def sample_files(files: DataFrame, k: int, seed: int, path: str = "path") -> list[str]:
    """``k`` different files chosen by seeded hash, for a trial run on part of a dataset."""
    chosen = files.orderBy(seeded_hash(path, seed), path).limit(k).select(path)
    return [row[0] for row in chosen.collect()]


def read_csv_schema(
    spark: SparkSession, path: str, schema: StructType | str, header: bool = False, sep: str = ","
) -> DataFrame:
    """CSV with declared names and types; no inference pass over the data."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def read_csv_skip_bad(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = "\t", header: bool = True
) -> DataFrame:
    """CSV or TSV in which malformed lines are skipped.

    A line is malformed if it has too many or too few fields or a value of the wrong type,
    whatever columns the query goes on to use.
    """
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = declared.fieldNames()
    rows = (
        spark.read.schema(StructType(list(declared.fields)).add("_broken", "string"))
        .option("header", header)
        .option("sep", sep)
        .option("columnNameOfCorruptRecord", "_broken")
        .csv(path)
    )
    # The parser only checks columns that are used: this always-true test uses all of them.
    all_used = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in names])) >= 0
    return rows.filter(F.col("_broken").isNull() & all_used).select(*names)


def read_json_columns(
    spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True
) -> DataFrame:
    """Chosen columns of a JSON export; the schema names them, so nothing else is parsed."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def folder_name(path: str | Column, part: int) -> Column:
    """Path segment counted from the end: 1 is the file, 2 its folder; null if there is none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.try_element_at(F.split(path, "/"), F.lit(-part))


def label_from_path(rows: DataFrame, part: int = 2, name: str = "label") -> DataFrame:
    """Add the name of the folder a row was read from; ``key=value`` folders give the value."""
    folder = folder_name(F.col("_metadata.file_path"), part)
    # The path is URL-encoded, but a plus sign in it stands for itself.
    folder = F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return rows.withColumn(name, F.element_at(F.split(folder, "="), -1))
