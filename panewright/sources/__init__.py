"""Reading tables, header CSV files and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is bound by computing, not reading: where its files make fewer partitions than there are cores, rows are
    spread evenly over these. Tables that fill the cores are read as they are, without a shuffle."""
    df = table(spark, folder, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def header_csv(spark: SparkSession, path: str, casts: dict[str, str] | None = None) -> DataFrame:
    """A CSV file with a header, every column a string but those named in `casts`; a value that can't be cast is NULL."""
    df = spark.read.option("header", True).csv(path)
    for name, kind in (casts or {}).items():
        df = df.withColumn(name, F.col(name).try_cast(kind))
    return df


def code(name: str) -> Column:
    """An airport code: upper case, without surrounding spaces."""
    return F.upper(F.trim(F.col(name)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else the one set on the context, else, in local sessions, one of our own."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = f"file://{tempfile.gettempdir()}/panewright-checkpoints"
        spark.conf.set("spark.checkpoint.dir", given)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Removes what this process has written to scratch paths and returns how many there were; results that read them must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = sum(bool(path(p).getFileSystem(conf).delete(path(p), True)) for p in _SCRATCH)
    _SCRATCH.clear()
    return removed
