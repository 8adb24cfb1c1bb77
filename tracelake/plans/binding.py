"""Driver tables read as session logs: ``events`` is a line log, its users are sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DAY_MS = 86_400_000
#: "now" of every query: the end of the event tables' month.
NOW = 1_706_659_200_000  # 2024-01-31T00:00:00Z


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # naive timestamps of the tables are read as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``user_id, event_id, event_type, k, units, ts_ms``: one row per event."""
    e = table(spark, sf, "events")
    return e.select(
        "user_id",
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("units"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )


#: The same rows for the oracle.
EVENTS_SQL = (
    "ev AS (SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
    "CAST(round(value * 100) AS BIGINT) AS units, epoch_us(ts) // 1000 AS ts_ms FROM events)"
)


def part_nodes(spark: SparkSession, sf: str, divisor: int = 3) -> DataFrame:
    """A deep forest over the parts: the parent of a part is its key divided by ``divisor``."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.expr(f"p_partkey div {divisor}").alias("parent"),
        "p_size",
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"),
    )
