"""Removal of repeated passages of lines: windows of three consecutive lines that occur again.

A text is cut at line feeds.  Every window of ``WINDOW`` consecutive lines is named by a 128-bit hash; of all windows
with a name, the first by (id, line) stays and the lines of every later one are covered.  Covered lines are merged into
spans and removed.  Windows are judged on the input, not on what is left.

The first of each name is a grouped minimum, combined before the shuffle; only windows that occur again, and then only
positions of one text, are brought together.  A null text counts as empty, which is one empty line; texts of fewer
lines than a window keep all of them.  A null id comes after all others, and of rows equal in id one comes first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, empty_if_null, stash, unused

WINDOW = 3


def window_names(text: Column, window: int = WINDOW) -> Column:
    """Struct of two longs for each window of lines, in order."""

    def names(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            lines = t.encode("utf-8", "replace").split(b"\n")
            raw = b"".join(xxhash.xxh3_128_digest(b"\n".join(lines[k : k + window])) for k in range(len(lines) - window + 1))
            out.append([{"a": a, "b": b} for a, b in np.frombuffer(raw, ">i8").reshape(-1, 2).tolist()])
        return pd.Series(out)

    return F.pandas_udf(names, "array<struct<a:long,b:long>>")(text)


def _kept(window: int):
    def kept(texts: pd.Series, later: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found in zip(texts, later, strict=True):
            lines = t.split("\n")
            covered = np.zeros(len(lines) + 2, np.int8)
            for k in () if found is None else found:
                covered[k + 1 : k + 1 + window] = 1
            spans = int((np.diff(covered) == 1).sum())
            gone = covered[1:-1].astype(bool)
            rows.append((len(lines), int(gone.sum()), spans, "\n".join(line for line, g in zip(lines, gone, strict=True) if not g)))
        return pd.DataFrame(rows, columns=["n_lines", "n_removed", "n_spans", "kept_text"])

    return kept


def without_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of every row with n_lines, n_removed, n_spans and kept_text."""
    carry = list(docs.columns) if carry is None else carry
    names = {c: unused(docs, f"_ld{k}") for k, c in enumerate(carry)}
    rows = docs.select(*[col(c).alias(n) for c, n in names.items()], col(id).alias("id"), empty_if_null(col(text)).alias("text"), F.monotonically_increasing_id().alias("uid"))
    rows = stash(rows, "line-rows")
    at = rows.select("id", "uid", F.posexplode(window_names(F.col("text"), window)).alias("k", "name"))
    at = stash(at.select("id", "uid", "k", "name.a", "name.b"), "line-windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "k")
    first = at.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = at.join(first, ["a", "b"]).where((F.col("uid") != F.col("first.uid")) | (F.col("k") != F.col("first.k")))
    later = later.groupBy("uid").agg(F.collect_list("k").alias("later"))
    out = rows.join(later, "uid", "left").withColumn("r", F.pandas_udf(_kept(window), "n_lines long, n_removed long, n_spans long, kept_text string")("text", "later"))
    return out.select(*[col(n).alias(c) for c, n in names.items()], "r.n_lines", "r.n_removed", "r.n_spans", "r.kept_text")
