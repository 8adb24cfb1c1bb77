"""Ordered per-key scans that do not put a hot key into one task.

A window over a whole session sorts that session in a single task.  Here every key is cut into segments
of ``span`` consecutive order values; the scan runs per (key, segment), a small summary per segment is
scanned per key, and both are joined.  The order column must be an integer (a line number, a time in ms).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SPAN = 65_536
_SEG = "__segment"


def _with_segment(df: DataFrame, by: Sequence[str], order: str, span: int) -> tuple[DataFrame, list[str]]:
    """``df`` with a segment number and key columns without nulls, and the names of those.

    A nullable key is kept as (is it null, value or a filler), so that windows, sums and the stitch all use the same
    plain columns and the rows are shuffled once.
    """
    keys, extra = [], {}
    for k, c in enumerate(by):
        field = df.schema[c]
        if not field.nullable:
            keys.append(c)
            continue
        filler = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(0).cast(field.dataType)
        extra |= {f"__seg_n{k}": F.col(c).isNull(), f"__seg_k{k}": F.coalesce(F.col(c), filler)}
        keys += [f"__seg_n{k}", f"__seg_k{k}"]
    return df.withColumns(extra | {_SEG: F.floor(F.col(order) / F.lit(span)).cast("bigint")}), keys


def _order_key(order: str, ties: Sequence[str]) -> Column:
    return F.struct(F.col(order), *[F.col(t) for t in ties])


def carry_last(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: Column,
    as_: str,
    *,
    ties: Sequence[str] = (),
    inclusive: bool = True,
    span: int = SPAN,
) -> DataFrame:
    """Add ``as_``: the latest non-null ``value`` at or before (``inclusive``) or strictly before each row."""
    seg, keys = _with_segment(df.withColumn("__seg_value", value), by, order, span)
    inner = Window.partitionBy(*keys, _SEG).orderBy(order, *ties)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = seg.withColumn("__seg_local", F.last("__seg_value", ignorenulls=True).over(inner))
    ends = seg.groupBy(*keys, _SEG).agg(
        F.max_by("__seg_value", F.when(F.col("__seg_value").isNotNull(), _order_key(order, ties))).alias("__seg_end")
    )
    outer = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, _SEG, F.last("__seg_end", ignorenulls=True).over(outer).alias("__seg_start"))
    starts = starts.where(F.col("__seg_start").isNotNull())
    out = local.join(starts, [*keys, _SEG], "left").withColumn(as_, F.coalesce("__seg_local", "__seg_start"))
    return out.select(*df.columns, as_)


def previous_row(
    df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], as_: str, *, ties: Sequence[str] = (), span: int = SPAN
) -> DataFrame:
    """Add ``as_``: a struct of ``cols`` of the row before (null for the first row of a key)."""
    row = F.struct(*[F.col(c) for c in cols])
    return carry_last(df, by, order, row, as_, ties=ties, inclusive=False, span=span)


def running_total(
    df: DataFrame, by: Sequence[str], order: str, value: Column, as_: str, *, ties: Sequence[str] = (), span: int = SPAN
) -> DataFrame:
    """Add ``as_``: the sum of ``value`` over this and all earlier rows of the key."""
    seg, keys = _with_segment(df.withColumn("__seg_value", value), by, order, span)
    inner = Window.partitionBy(*keys, _SEG).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.withColumn("__seg_local", F.sum("__seg_value").over(inner))
    sums = seg.groupBy(*keys, _SEG).agg(F.sum("__seg_value").alias("__seg_sum"))
    outer = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, _SEG, F.sum("__seg_sum").over(outer).alias("__seg_start")).where(F.col("__seg_start").isNotNull())
    out = local.join(starts, [*keys, _SEG], "left")
    out = out.withColumn(as_, F.coalesce("__seg_local", F.lit(0)) + F.coalesce("__seg_start", F.lit(0)))
    return out.select(*df.columns, as_)


def position(
    df: DataFrame, by: Sequence[str], order: str, as_: str = "position", *, ties: Sequence[str] = (), span: int = SPAN
) -> DataFrame:
    """Add ``as_``: the 1-based position of the row in its key."""
    return running_total(df, by, order, F.lit(1).cast("bigint"), as_, ties=ties, span=span)
