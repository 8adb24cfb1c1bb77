"""A keyed table as versions per micro-batch: what a stream with a ``foreachBatch`` sink has to remember.

Batch n writes only the rows it changes to ``<store>/v/batch=n``; the current table is the newest version of every
key.  Every ``compact_every`` batches the current table is written as a whole to ``<store>/base/batch=n``, and versions
no replay can ask for any more are dropped.  A replayed batch sees what it saw the first time and overwrites its folder.
Nothing is kept in memory or on one machine, and only folder names reach the driver (at most two compactions' worth).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

COMPACT_EVERY = 16


def _folders(spark: SparkSession, root: str) -> list[int]:
    """Ids of the complete batch folders below ``root``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    ids = [int(n[6:]) for n in names if n.startswith("batch=") and n[6:].isdigit()]
    return sorted(i for i in ids if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/batch={i}/_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def current(spark: SparkSession, store: str, key: Sequence[str], schema, before: int | None = None) -> DataFrame:
    """The newest row of every key among the batches before ``before`` (default: all)."""
    ok = lambda i: before is None or i < before
    base = max((i for i in _folders(spark, f"{store}/base") if ok(i)), default=None)
    later = [i for i in _folders(spark, f"{store}/v") if ok(i) and (base is None or i > base)]
    parts = [spark.read.schema(schema).parquet(f"{store}/base/batch={base}").withColumn("__b", F.lit(base).cast("bigint"))] if base is not None else []
    parts += [spark.read.schema(schema).parquet(f"{store}/v/batch={i}").withColumn("__b", F.lit(i).cast("bigint")) for i in later]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rest = [c for c in rows.columns if c not in (*key, "__b")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "__b").alias("__r"))
    return newest.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def write(changed: DataFrame, store: str, batch_id: int, key: Sequence[str], keep: Column | None = None, compact_every: int = COMPACT_EVERY) -> None:
    """Write the changed rows of a batch; now and then the whole table, of which only the rows ``keep`` stay."""
    spark = changed.sparkSession
    changed.write.mode("overwrite").parquet(f"{store}/v/batch={batch_id}")
    if (batch_id + 1) % compact_every:
        return
    whole = current(spark, store, key, changed.schema, batch_id + 1)
    (whole if keep is None else whole.where(keep)).write.mode("overwrite").parquet(f"{store}/base/batch={batch_id}")
    bases = _folders(spark, f"{store}/base")
    if len(bases) > 1:  # the base before this one, and the versions since, serve a replay of this batch
        for i in _folders(spark, f"{store}/v"):
            if i <= bases[-2]:
                _drop(spark, f"{store}/v/batch={i}")
        for i in bases[:-2]:
            _drop(spark, f"{store}/base/batch={i}")


def start(stream: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None, mode: str = "append"):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(flush)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
