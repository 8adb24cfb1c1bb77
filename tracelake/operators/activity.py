"""Activity over time: per-minute counts, sparklines, tool ticks, concurrency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.session import cut_lineage
from tracelake.operators.segments import position

# --- fixed values ---------------------------------------------------------------------------------
MINUTE_MS = 60_000
BUCKETS = 30
KEEP_MINUTES = 60
#: Widths a concurrency histogram may use, in ms.
CONCURRENCY_BUCKETS = tuple(s * 1000 for s in (60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 43200, 86400))
# --- end of fixed values --------------------------------------------------------------------------


def activity_minutes(events: DataFrame, by: Sequence[str], ts: str = "ts_ms", now: int | None = None, keep: int = KEEP_MINUTES) -> DataFrame:
    """Events per minute; with ``now`` only the last ``keep`` minutes."""
    rows = events if now is None else events.where(F.col(ts) >= now - keep * MINUTE_MS)
    minute = F.floor(F.col(ts) / MINUTE_MS).cast("bigint").alias("minute")
    return rows.groupBy(*by, minute).agg(F.count(F.lit(1)).alias("n"))


def activity_buckets(events: DataFrame, by: Sequence[str], ts: str = "ts_ms", now: int = 0, n: int = BUCKETS) -> DataFrame:
    """``counts``: one dense array of ``n`` minutes per key, ending with the minute of ``now`` (``end``).

    At most ``n`` + 1 rows per key reach the last step.
    """
    end = now // MINUTE_MS
    lo, hi = (end - n + 1) * MINUTE_MS, (end + 1) * MINUTE_MS
    # one pass: what lies outside the window is counted under no minute, so that its key is known too
    minute = F.when((F.col(ts) >= lo) & (F.col(ts) < hi), F.floor(F.col(ts) / MINUTE_MS).cast("bigint"))
    minutes = events.groupBy(*by, minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    filled = F.map_from_entries(F.collect_list(F.when(F.col("minute").isNotNull(), F.struct("minute", "n"))))
    dense = F.transform(
        F.sequence(F.lit(end - n + 1), F.lit(end)), lambda m: F.coalesce(F.try_element_at(F.col("__m"), m), F.lit(0).cast("bigint"))
    )
    out = minutes.groupBy(*by).agg(filled.alias("__m"))
    return out.select(*by, F.lit(end * MINUTE_MS).cast("bigint").alias("end"), dense.alias("counts"))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def tick_offsets(
    ticks: DataFrame, by: Sequence[str], ts: str = "ts_ms", start: str = "started_at", max_ticks: int | None = None
) -> DataFrame:
    """Distinct whole seconds after ``start``, ascending; with ``max_ticks``, sampled to so many by even steps.

    Sampling happens on positions before anything is collected, so an array never exceeds ``max_ticks``.
    """
    second = F.greatest(F.lit(0), round_half_up((F.col(ts) - F.col(start)) / 1000)).cast("bigint")
    distinct = ticks.where(F.col(start).isNotNull() & F.col(ts).isNotNull()).select(*by, second.alias("second")).distinct()
    if max_ticks is None:
        return distinct.groupBy(*by).agg(F.array_sort(F.collect_list("second")).alias("ticks"))
    placed = position(distinct, by, "second", "__p")
    total = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    placed = placed.join(total, list(by))
    step = F.col("__n") / F.lit(float(max_ticks))
    at = F.col("__p") - 1
    guess = F.floor(at / step)
    hit = F.lit(False)
    for d in (0, 1, 2):
        hit = hit | ((F.floor((guess + d) * step) == at) & (guess + d < max_ticks))
    kept = placed.where((F.col("__n") <= max_ticks) | hit)
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list("second")).alias("ticks"))


def time_extent(nodes: DataFrame, by: Sequence[str], now: int) -> DataFrame:
    """``t0`` and ``t1`` of each tree; a live tree extends to ``now``."""
    live = F.bool_or(F.col("live") | F.col("state").isin("running", "idle", "stalled"))
    end = F.max(F.coalesce("ended_at", "last_activity_at", "started_at"))
    return nodes.groupBy(*by).agg(
        F.min("started_at").alias("t0"), F.when(live, F.greatest(end, F.lit(now))).otherwise(end).alias("t1"), live.alias("live")
    )


def pick_bucket(span_ms: float, max_buckets: int = 300) -> int:
    """The smallest standard width that needs at most ``max_buckets`` buckets for the span."""
    for b in CONCURRENCY_BUCKETS:
        if span_ms / b <= max_buckets:
            return b
    return CONCURRENCY_BUCKETS[-1]


def _edges(intervals: DataFrame, by: Sequence[str], start: str, end: str, bucket_ms: int) -> DataFrame:
    """The buckets at which the number of intervals alive changes, and by how much.

    Each interval contributes +1 at its first bucket and -1 after its last one.  The end is exclusive by one ms, and an empty
    interval fills one bucket.
    """
    first = F.floor(F.col(start) / bucket_ms).cast("bigint")
    last = F.floor(F.greatest(F.col(start), F.col(end) - 1) / bucket_ms).cast("bigint")
    rows = intervals.where(F.col(start).isNotNull()).select(*by, first.alias("__i0"), last.alias("__i1"))
    one = lambda bucket, d: F.struct(bucket.alias("bucket"), F.lit(d).alias("d"))
    steps = rows.select(*by, F.explode(F.array(one(F.col("__i0"), 1), one(F.col("__i1") + 1, -1))).alias("__s")).select(*by, "__s.*")
    # a bucket where as many begin as end stays: it may be the first or the last
    return steps.groupBy(*by, "bucket").agg(F.sum("d").alias("d"))


def prefix_sums(rows: DataFrame, order: str, value: str, as_: str, next_: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row in the order of the unique ``order``, and the next row's ``order``.

    Rows are sorted by range once; each range part is summed by itself, the few sums of parts are added up, and their
    totals become offsets.  No task sees more than a part.
    """
    placed = cut_lineage(rows.orderBy(order).withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33)))
    parts = placed.groupBy("__part").agg(F.sum(value).alias("__sum"), F.min(order).alias("__low"))
    listed = F.array_sort(F.collect_list(F.struct("__part", "__sum", "__low")))
    grown = F.aggregate(
        "__all", F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc["sum"] + x["__sum"]).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"],
    )
    known = parts.groupBy().agg(listed.alias("__all")).select(F.posexplode(F.arrays_zip("__all", grown.alias("__before"))).alias("__i", "__p"), "__all")
    known = known.select(F.col("__p.__all.__part").alias("__part"), F.col("__p.__before").alias("__before"), F.try_element_at("__all", F.col("__i") + 2)["__low"].alias("__following"))
    w = Window.partitionBy("__part").orderBy(order)
    out = placed.join(known, "__part")
    out = out.withColumns({as_: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before"), next_: F.coalesce(F.lead(order).over(w), "__following")})
    return out.select(*rows.columns, as_, next_)


def concurrency_runs(intervals: DataFrame, by: Sequence[str] = (), start: str = "started_at", end: str = "ended_at", bucket_ms: int = MINUTE_MS) -> DataFrame:
    """Intervals alive as runs ``bucket_start`` to ``run_end`` (exclusive) between changes: the result grows with the intervals, not with
    the time between them."""
    change = _edges(intervals, by, start, end, bucket_ms)
    if by:
        order = Window.partitionBy(*by).orderBy("bucket")
        runs = change.withColumns({"__next": F.lead("bucket").over(order), "alive": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    else:
        runs = prefix_sums(change, "bucket", "d", "alive", "__next")
    runs = runs.where(F.col("__next").isNotNull())
    return runs.select(*by, (F.col("bucket") * bucket_ms).alias("bucket_start"), (F.col("__next") * bucket_ms).alias("run_end"), F.col("alive").cast("bigint").alias("alive"))


def concurrency(
    intervals: DataFrame, by: Sequence[str] = (), start: str = "started_at", end: str = "ended_at", bucket_ms: int = MINUTE_MS
) -> DataFrame:
    """Intervals alive per bucket, zero-filled between the first and the last.

    One row per bucket, also across gaps; where a wild time may open a gap, take :func:`concurrency_runs`.
    """
    runs = concurrency_runs(intervals, by, start, end, bucket_ms)
    dense = runs.withColumn("bucket_start", F.explode(F.sequence(F.col("bucket_start"), F.col("run_end") - bucket_ms, F.lit(bucket_ms).cast("bigint"))))
    return dense.select(*by, "bucket_start", "alive")
