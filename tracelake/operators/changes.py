"""Change detection between snapshots, and order-free digests of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def changed_rows(prev: DataFrame, cur: DataFrame, key: Sequence[str], signature: Sequence[str]) -> DataFrame:
    """Keys that appeared, went or changed their signature, with ``change`` = added, removed or changed.

    One aggregation over the union replaces a full outer join: each key has at most one row per side.
    """
    sig = F.struct(*signature)
    both = prev.select(*key, sig.alias("s"), F.lit(0).alias("side")).unionByName(
        cur.select(*key, sig.alias("s"), F.lit(1).alias("side"))
    )
    old = F.max_by("s", F.when(F.col("side") == 0, 1)).alias("old")
    new = F.max_by("s", F.when(F.col("side") == 1, 1)).alias("new")
    seen = both.groupBy(*key).agg(old, new)
    change = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(~F.col("old").eqNullSafe(F.col("new")), F.lit("changed"))
    )
    return seen.withColumn("change", change).where(F.col("change").isNotNull()).select(*key, "change")


def facts_hash(df: DataFrame, by: Sequence[str], cols: Sequence[str], as_: str = "facts_hash") -> DataFrame:
    """A digest of each group's rows that does not depend on their order.

    The row digests are added up (exact decimals), which combines map-side; no group is collected.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    row = df.select(*by, F.md5(text).alias("__h"))
    part = lambda start: F.conv(F.substring("__h", start, 15), 16, 10).cast("decimal(20,0)")
    sums = row.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(part(1)).cast("decimal(38,0)").alias("__a"), F.sum(part(16)).cast("decimal(38,0)").alias("__b")
    )
    digest = F.sha1(F.concat_ws(":", F.col("__n").cast("string"), F.col("__a").cast("string"), F.col("__b").cast("string")))
    return sums.select(*by, F.substring(digest, 1, 16).alias(as_))
