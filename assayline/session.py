"""Session settings, test tables and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", name: str = "assayline") -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SPREAD_BYTES = 128 * 1024 * 1024


def spread_table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """A text table dealt out to all cores when it is too small to be split by itself.

    A small file is one row group and so one task, whatever is done with its texts. A table
    of ``SPREAD_BYTES`` or more is read as it is, without a shuffle, on any number of cores.
    """
    path = f"{folder}/{name}.parquet"
    cores = spark.sparkContext.defaultParallelism
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    rows = spark.read.parquet(path).select(*columns)
    return rows.repartition(cores) if size < SPREAD_BYTES else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the session names it.

    Only a local master may fall back to a folder of this machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="assayline-")
    return _local_folder


_local_folder: str | None = None


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files_at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, place = _files_at(spark, path)
    return files.exists(place)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, place = _files_at(spark, path)
    files.delete(place, True)


@contextmanager
def scratch(spark: SparkSession, below: str | None = None) -> Iterator[str]:
    """Intermediates written inside this block are deleted at its end.

    They lie below ``below``, which executors share, or else in the shared folder. No frame that
    reads them may be used after the block.
    """
    folder = f"{below}/scratch-{uuid.uuid4().hex}" if below else fresh_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        delete_folder(spark, folder)


def materialise(df: DataFrame, name: str, partition_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps then neither recompute it nor depend on cached executor blocks. With
    ``partition_bytes`` a small result is dealt out into about one partition per that many
    written bytes, at most one per core: an iterative fit then neither runs on one core nor
    pays for empty tasks. A result of ``SPREAD_BYTES`` per core or more is left as it is.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return dealt_out(spark.read.schema(df.schema).parquet(path), path, partition_bytes)


def dealt_out(written: DataFrame, path: str, partition_bytes: int | None) -> DataFrame:
    """The rows written at ``path``, dealt out as ``materialise`` says."""
    spark = written.sparkSession
    if partition_bytes is None:
        return written
    cores = spark.sparkContext.defaultParallelism
    sizes = spark.read.format("binaryFile").load(path).agg(F.sum("length"))
    size = int(sizes.first()[0] or 0)
    if size >= SPREAD_BYTES * cores:
        return written
    return written.repartition(min(cores, 1 + size // partition_bytes))


BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast side if it really has at most ``max_rows`` rows, else unchanged.

    The rows are fetched once, at most one more than the limit; a frame within it is not
    computed again. Beyond it the caller's join is an ordinary shuffled one.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
