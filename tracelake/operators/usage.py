"""Token usage: counted once per message, from counters, and rolled up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.operators.pricing import COUNTERS, token_total
from tracelake.operators.segments import carry_last, previous_row

__all__ = [
    "choose_usage",
    "dedup_usage",
    "json_usage_today",
    "normalise_usage",
    "token_total",
    "usage_from_totals",
    "usage_rollup",
    "with_carried_model",
]


def dedup_usage(
    df: DataFrame, key: str = "message_key", order: str = "ord", keep: str = "last", partition: Sequence[str] = ("file",)
) -> DataFrame:
    """One row per message: the ``last`` or the ``first`` line of each key wins.

    ``max_by``/``min_by`` combine map-side, so a key repeated in a third of all lines costs one row per
    input task in the shuffle instead of a single overloaded window task.
    """
    keys = [*partition, key]
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    won = df.where(F.col(key).isNotNull()).groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("__row"))
    return won.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def with_carried_model(
    df: DataFrame,
    model: str = "model",
    order: str = "ord",
    partition: Sequence[str] = ("file",),
    where: Column | None = None,
    fallback: Column | None = None,
) -> DataFrame:
    """Fill a missing model with the latest one seen earlier in the file, else ``fallback``, else ``unknown``.

    ``where`` says which lines may set the model.  Run this before :func:`dedup_usage`.
    """
    value = F.col(model) if where is None else F.when(where, F.col(model))
    out = carry_last(df, partition, order, value, "__model")
    filled = F.coalesce(F.col("__model"), *([fallback] if fallback is not None else []), F.lit("unknown"))
    return out.withColumn(model, filled).drop("__model")


def usage_from_totals(
    df: DataFrame, counters: Sequence[str], partition: Sequence[str] = ("file",), order: str = "ord"
) -> DataFrame:
    """Deltas of running totals: the first total counts whole, a shrinking counter restarts, zero deltas go."""
    prev = previous_row(df, partition, order, counters, "__prev")
    deltas = {c: F.col(c) - F.col("__prev")[c] for c in counters}
    least = list(deltas.values())
    shrunk = (F.least(*least) if len(least) > 1 else least[0]) < 0
    fresh = F.col("__prev").isNull() | shrunk
    out = prev.withColumns({f"__d_{c}": F.when(fresh, F.col(c)).otherwise(d) for c, d in deltas.items()})
    total = F.lit(0).cast("bigint")
    for c in counters:
        total = total + F.coalesce(F.col(f"__d_{c}"), F.lit(0))
    keep = [F.col(f"__d_{c}").alias(c) if c in counters else F.col(c) for c in df.columns]
    return out.where(total > 0).select(*keep)


def choose_usage(primary: DataFrame, fallback: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the primary rows when there are any, else the fallback rows."""
    have = primary.select(*by).distinct()
    return primary.unionByName(fallback.join(have, list(by), "left_anti"), allowMissingColumns=True)


def usage_rollup(df: DataFrame, sets: Sequence[Sequence[str]], counters: Sequence[str] = COUNTERS[:4]) -> DataFrame:
    """Sums for several grouping sets in one pass; ``grouping_key`` names the set a row belongs to."""
    dims: list[str] = []
    for s in sets:
        dims += [c for c in s if c not in dims]
    counters = [c for c in counters if c in df.columns]
    label = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])
    return (
        df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims])
        .agg(label.alias("grouping_key"), *[F.sum(c).alias(c) for c in counters], F.count(F.lit(1)).alias("messages"))
        .select("grouping_key", *dims, *counters, "messages")
    )


def normalise_usage(shape: str, u: Column) -> Column:
    """Vendor counters to ``struct(input, output, cache_read, cache_create, cache_create_1h)``; null without usage.

    ``direct``: counters as they are.  ``inclusive``: the input includes cached and cache-write tokens.
    ``thoughts``: the input includes cached tokens, tool prompts are extra input, thoughts are output.
    """
    n = lambda name: F.coalesce(u[name], F.lit(0.0))
    if shape == "direct":
        write = n("cache_creation_input_tokens")
        hour = u["cache_creation"]["ephemeral_1h_input_tokens"]
        parts = (
            n("input_tokens"),
            n("output_tokens"),
            n("cache_read_input_tokens"),
            write,
            F.when(hour > 0, F.least(hour, write)),
        )
        present = u.isNotNull()
    elif shape == "inclusive":
        cached, write = n("cached_input_tokens"), n("cache_write_input_tokens")
        parts = (
            F.greatest(F.lit(0.0), n("input_tokens") - cached - write),
            n("output_tokens"),
            cached,
            write,
            F.lit(None).cast("double"),
        )
        present = u["input_tokens"].isNotNull() | u["output_tokens"].isNotNull()
    elif shape == "thoughts":
        p = lambda name: F.greatest(F.lit(0.0), n(name))
        parts = (
            F.greatest(F.lit(0.0), p("input") - p("cached")) + p("tool"),
            p("output") + p("thoughts"),
            p("cached"),
            F.lit(0.0),
            F.lit(None).cast("double"),
        )
        present = u.isNotNull()
    else:
        raise ValueError(f"unknown usage shape: {shape}")
    value = F.struct(*[p.cast("bigint").alias(c) for p, c in zip(parts, COUNTERS)])
    return F.when(present, value)


def json_usage_today(messages: DataFrame, day_start_ms: int, by: Sequence[str] = (), data: str = "data") -> DataFrame:
    """Output (with reasoning) tokens and recorded cost of assistant messages created since ``day_start_ms``."""
    get = lambda path: F.coalesce(F.get_json_object(F.col(data), path).cast("double"), F.lit(0.0))
    today = messages.where(
        (F.col("time_created") >= day_start_ms) & (F.get_json_object(F.col(data), "$.role") == "assistant")
    )
    money = F.get_json_object(F.col(data), "$.cost").cast("decimal(20,9)")
    return today.groupBy(*by).agg(
        F.sum(get("$.tokens.output") + get("$.tokens.reasoning")).cast("bigint").alias("output_today"),
        F.coalesce(F.sum(money), F.lit(0).cast("decimal(30,9)")).cast("double").alias("cost_today"),
    )
