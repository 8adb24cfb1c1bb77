"""Parsed logs with a sparse index, so that a page reads only the blocks it needs.

``write_log`` lays events out in parts by (log, block): a block is a fixed span of byte offsets of one log, a part a range of
blocks in one folder.  Beside it goes the index: one row per log and block with its part, first and last offset, least and
greatest time and number of events.  A page first chooses blocks by the index alone; the parts they lie in reach the scan as
a partition filter, and the blocks as a join, so no other text is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracelake.operators.events import TAIL_DEFAULT, event_page

#: Offsets of a block.
BLOCK = 1 << 20


def write_log(events: DataFrame, path: str, by: Sequence[str] = ("file",), order: str = "ord", ts: str = "ts_ms", block: int = BLOCK, parts: int | None = None) -> None:
    """Write ``events`` and their index below ``path``.  A log of any size spreads over as many parts as it fills."""
    keys = [*by, "block"]
    placed = events.withColumn("block", F.floor(F.col(order) / block).cast("bigint"))
    placed = placed.repartitionByRange(parts, *keys) if parts else placed.repartitionByRange(*keys)
    placed = placed.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys, order)
    placed.write.mode("overwrite").partitionBy("part").parquet(f"{path}/log")
    # a log without rows leaves no file that says what its columns are
    placed.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    written = _log(events.sparkSession, path)
    stamp = F.col(ts).cast("bigint") if ts in events.columns else F.lit(None).cast("bigint")
    index = written.groupBy("part", *keys).agg(
        F.min(order).alias("first_ord"), F.max(order).alias("last_ord"), F.min(stamp).alias("min_ts"), F.max(stamp).alias("max_ts"), F.count(F.lit(1)).alias("n")
    )
    index.write.mode("overwrite").parquet(f"{path}/index")


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/log")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """part, log columns, block, first_ord, last_ord, min_ts, max_ts, n."""
    return spark.read.parquet(f"{path}/index")


def blocks_of(index: DataFrame, by: Sequence[str] = ("file",), tail: int | None = None, before: int | None = None, after: int | None = None, since_ms: int | None = None) -> DataFrame:
    """The index rows a page needs.

    A tail needs a block when fewer than ``tail`` events lie in later blocks; of a page before an offset the block that
    holds it counts as empty, as the index does not say how much of it is older.  A page after an offset needs the blocks
    that end at or behind it, one since a time those that reach it.
    """
    if since_ms is not None:
        index = index.where(F.col("max_ts") >= since_ms)
    if after is not None:
        return index.where(F.col("last_ord") >= after)
    want = max(1, tail if tail is not None else TAIL_DEFAULT)
    if before is not None:
        index = index.where(F.col("first_ord") < before)
    sure = F.col("n") if before is None else F.when(F.col("last_ord") < before, F.col("n")).otherwise(0)
    later = Window.partitionBy(*by).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # every block but one cut by ``before`` holds an event, so no more than this many are needed: a rank limit keeps the sum short
    near = index.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("block").desc()))).where(F.col("__r") <= want + 1)
    return near.withColumn("__later", F.coalesce(F.sum(sure).over(later), F.lit(0))).where(F.col("__later") < want).drop("__r", "__later")


def read_blocks(spark: SparkSession, path: str, chosen: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """The events of the chosen index rows; their parts prune the scan."""
    return _log(spark, path).join(chosen.select("part", *by, "block"), ["part", *by, "block"], "left_semi").drop("part", "block")


def page(
    spark: SparkSession, path: str, by: Sequence[str] = ("file",), order: str = "ord", tail: int | None = None, before: int | None = None, after: int | None = None, limit: int | None = None
) -> DataFrame:
    """The rows of :func:`event_page` for every log, from the chosen blocks only."""
    index = read_index(spark, path)
    chosen = blocks_of(index, by, tail, before, after)
    out = event_page(read_blocks(spark, path, chosen, by), by, order, tail, before, after, limit)
    if after is not None:
        return out
    first = index.groupBy(*by).agg(F.min("first_ord").alias("__start"))
    return out.join(first, list(by)).withColumn("truncated", F.col("page_start") > F.col("__start")).drop("__start")
