"""Lines added and removed by edits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_HEADER = "\\*\\*\\* (Update|Add|Delete) File: ([^\\n\\r]+)"


def patch_files(patch: Column | str) -> Column:
    """Files of a patch body: ``array<struct(op, path, move_to, added, removed)>``.

    The text is split where a file header line starts; lines before the first header are not counted.
    """
    patch = F.col(patch) if isinstance(patch, str) else patch
    sections = F.filter(F.split(patch, f"(?<![^\\n])(?={_HEADER})"), lambda s: s.rlike("^" + _HEADER))

    def one(s: Column) -> Column:
        body = F.split(s, "\n")
        return F.struct(
            F.lower(F.regexp_extract(s, "^" + _HEADER, 1)).alias("op"),
            F.trim(F.regexp_extract(s, "^" + _HEADER, 2)).alias("path"),
            F.nullif(F.trim(F.regexp_extract(s, "(?<![^\\n])\\*\\*\\* Move to: ([^\\n\\r]+)", 1)), F.lit("")).alias("move_to"),
            F.size(F.filter(body, lambda x: F.startswith(x, F.lit("+")))).cast("bigint").alias("added"),
            F.size(F.filter(body, lambda x: F.startswith(x, F.lit("-")))).cast("bigint").alias("removed"),
        )

    return F.transform(sections, one)


def edit_churn(calls: DataFrame, by: Sequence[str], patch: str = "patch") -> DataFrame:
    """Lines added and removed per group and file over all patch calls.

    The line counts are taken inside the row, so only (group, file, counts) rows are shuffled.
    """
    files = calls.select(*by, F.explode(patch_files(patch)).alias("__f")).select(*by, "__f.*")
    return files.groupBy(*by, "path").agg(
        F.count(F.lit(1)).alias("edits"), F.sum("added").alias("added"), F.sum("removed").alias("removed")
    )


def _line_delta(old: str, new: str) -> tuple[int, int]:
    """Lines added and removed between two texts (common ends trimmed, then longest common subsequence)."""
    a = old.split("\n") if old else []
    b = new.split("\n") if new else []
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    n, m = hi_a - lo, hi_b - lo
    if n == 0 or m == 0:
        return m, n
    # bit-parallel LCS: one big integer holds a row of the table
    seen: dict[str, int] = {}
    for i in range(n):
        seen[a[lo + i]] = seen.get(a[lo + i], 0) | (1 << i)
    full = (1 << n) - 1
    row = full
    for j in range(m):
        hit = seen.get(b[lo + j], 0) & row
        row = ((row + hit) | (row - hit)) & full
    common = n - row.bit_count()
    return m - common, n - common


def with_line_delta(df: DataFrame, old: str = "old_string", new: str = "new_string") -> DataFrame:
    """Add ``added`` and ``removed`` lines of each old/new pair."""

    @F.pandas_udf("added bigint, removed bigint")
    def delta(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for olds, news in batches:
            rows = [_line_delta(o or "", n or "") for o, n in zip(olds, news)]
            yield pd.DataFrame(rows, columns=["added", "removed"])

    return df.withColumn("__d", delta(old, new)).select(*df.columns, "__d.added", "__d.removed")


def edit_line_delta(
    calls: DataFrame, by: Sequence[str], old: str = "old_string", new: str = "new_string"
) -> DataFrame:
    """Lines added and removed per group over all old/new edits."""
    rows = with_line_delta(calls.select(*by, old, new), old, new)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("edits"), F.sum("added").alias("added"), F.sum("removed").alias("removed")
    )
