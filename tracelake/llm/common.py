"""What the operators share: tables in the shared folder, row identities, text as bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where it is unset (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tracelake-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at a time by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stash(df: DataFrame, name: str, partition_by: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: cuts the lineage and survives lost executors.

    paths: takes the folder's name, for ``drop``.
    """
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete stashed tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    paths.clear()


def renamed(docs: DataFrame, prefix: str = "_in") -> DataFrame:
    """``docs`` with numbered column names: whatever its columns are called, they clash with nothing."""
    return docs.toDF(*[f"{prefix}{k}" for k in range(len(docs.columns))])


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers wait for the next task with what they hold."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(columns: list[str], new: list[str]) -> list[str]:
    """``columns`` without those that new ones replace, whatever their letter case."""
    taken = {c.lower() for c in new}
    return [c for c in columns if c.lower() not in taken]


def col(name: str) -> Column:
    """A column by its plain name, also where the name holds dots or backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
