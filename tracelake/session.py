"""Session settings and lineage control shared by every job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs are written for.  AQE re-plans joins from measured sizes (so a side is broadcast
#: only when it is known to be small) and splits hot join keys; UTC makes day arithmetic explicit.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tracelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: ``spark.checkpoint.dir``.  One of our own is made only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Whether the shuffle files of a query are deleted when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint an iterative result into the shared folder named by ``spark.checkpoint.dir``.

    Reliable checkpoints survive the loss of executors.  A folder of our own is made only in local
    mode (tests); on a cluster a missing setting is an error, never a machine-local folder.
    The shuffle files behind it go when it is written: nothing reads them any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            path = tempfile.mkdtemp(prefix="tracelake-checkpoint-")
        sc.setCheckpointDir(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, planned under the setting
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
