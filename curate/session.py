"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "curate") -> SparkSession:
    """A single-machine session for tests and the bench.

    On a cluster the session comes from ``spark-submit``; nothing in the library
    sets partition counts or memory.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local
    master without that setting gets a temporary folder of its own.
    """
    ctx = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if ctx.getCheckpointDir():
        return ctx.getCheckpointDir().rstrip("/")
    if not ctx.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="curate-")
    ctx.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one for the tables written inside the ``with`` block, removed at its end.

    Results that are read from those tables have to be written elsewhere before the block ends.
    """
    path = fresh_path(spark, "scratch")
    _SCRATCH.append(path)
    try:
        yield path
    finally:
        _SCRATCH.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Folders of the scopes that are open, innermost last.
_SCRATCH: list[str] = []


def materialize(rows: DataFrame, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write ``rows`` as Parquet and scan the result, which cuts the lineage.

    The table lives on shared storage, so a lost executor costs no recomputation
    of what came before. Inside ``scratch`` it is removed when the block ends.
    """
    if path is None:
        path = f"{_SCRATCH[-1]}/table-{uuid.uuid4().hex}" if _SCRATCH else fresh_path(rows.sparkSession, "table")
    rows.write.mode(mode).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores if they arrive in fewer pieces than that, as from a file with one row group."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to at least all cores, for work that costs far more than its rows: pieces of a scan may be empty."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet, as they do in ``groupBy``; ``left`` keeps the keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])
