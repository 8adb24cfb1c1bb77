"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers x = floor(64 * c) + 1000000.  Tasks add up counts and sums, then products of entries centred
at the rounded mean; both are whole numbers and stay exact, so the covariance is the true one rounded once, whatever the
order of the rows.  Its pivoted Cholesky factor L (V = L L') is rotated from the right until its columns are orthogonal:
their squared norms are the eigenvalues, the normalised columns the components.

Only the covariance (dimensions squared) is ever on the driver, for at most ``DIMENSIONS`` dimensions.  Rows whose vector is
null, empty, holds a null or non-finite entry or one beyond a long's range are left out; so are rows whose length is not the
most frequent one (of equally frequent ones the longest stays).  Repeated rows count as often as they occur; null ids stay.
Directions without spread beyond rounding give no component.  An empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracelake.llm.common import col, small_batches

#: Steps per unit, the offset of whole numbers, components returned, and dimensions that the driver factorises.
STEPS, OFFSET, COMPONENTS, DIMENSIONS = 64, 1_000_000, 32, 4096
#: Sums travel as two whole numbers, so that none outgrows a decimal.
_HALF = 80
_WIDE = pa.decimal128(38, 0)


class Fit(NamedTuple):
    """n, the sums S, and by component: eigenvalue, share of the trace, direction (one row each)."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    directions: np.ndarray


def entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (-1: not usable), first places and the flat entries as doubles (nan for null) of a list array."""
    flat = vectors.flatten().cast(pa.float64())
    flat = flat.to_numpy(zero_copy_only=False) if flat.null_count == 0 else np.where(flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False), np.nan)
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0**56))])
    length = np.where((size > 0) & (bad[start + size] == bad[start]), size, -1)
    return length, start, flat


def whole(flat: np.ndarray, start: np.ndarray, d: int) -> np.ndarray:
    """The rows x that begin at ``start``, one per vector."""
    return np.floor(flat[start[:, None] + np.arange(d)] * STEPS).astype(np.int64) + OFFSET


def _centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return x - middle


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    small = len(x) * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
    return x.sum(0).astype(object) if small else x.astype(object).sum(0)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers; doubles hold the sums exactly while they stay below 2^53."""
    if len(y) * (int(np.abs(y).max(initial=0)) + 1) ** 2 < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def _halves(values: list[int]) -> tuple[pa.Array, pa.Array]:
    high = pa.array([Decimal(v >> _HALF) for v in values], _WIDE)
    return high, pa.array([Decimal(v & ((1 << _HALF) - 1)) for v in values], _WIDE)


def _joined(row) -> int:
    return (int(row["high"]) << _HALF) + int(row["low"])


def _sum_halves() -> list:
    return [F.sum("high").alias("high"), F.sum("low").alias("low")]


def totals(rows: DataFrame) -> tuple[int, int, list[int]]:
    """(dimensions, n, sums) of the most frequent length of the column ``v``; n is 0 if there is no usable vector."""

    def each(batches):
        found: dict[int, list] = {}
        for batch in batches:
            length, start, flat = entries(batch["v"])
            for d in np.unique(length[length > 0]).tolist():
                x = whole(flat, start[length == d], d)
                own = found.setdefault(d, [0, np.zeros(d, object)])
                own[0] += len(x)
                own[1] += exact_sums(x)
        for d, (n, sums) in found.items():
            high, low = _halves(sums.tolist())
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int64()), pa.array(np.arange(d)), pa.array([n] * d, pa.int64()), high, low], ["d", "i", "n", "high", "low"])

    parts = rows.mapInArrow(each, "d long, i long, n long, high decimal(38,0), low decimal(38,0)")
    sums = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), *_sum_halves()).persist()
    top = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if top is None:
        return 0, 0, []
    if top["d"] > DIMENSIONS:
        raise ValueError(f"{top['d']} dimensions; at most {DIMENSIONS} are factorised")
    of = {r["i"]: _joined(r) for r in sums.where(F.col("d") == top["d"]).collect()}
    sums.unpersist()
    return top["d"], top["n"], [of[i] for i in range(top["d"])]


def covariance(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of x with divisor n, each entry rounded once."""
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    i, j = np.tril_indices(d)

    def each(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            length, start, flat = entries(batch["v"])
            total += exact_products(_centred(whole(flat, start[length == d], d), middle))
        high, low = _halves(total[i, j].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(i * d + j), high, low], ["at", "high", "low"])

    parts = rows.mapInArrow(each, "at long, high decimal(38,0), low decimal(38,0)").groupBy("at").agg(*_sum_halves())
    rest = [s - n * m for s, m in zip(sums, middle.tolist(), strict=True)]
    v = np.zeros((d, d))
    for r in parts.collect():
        a, b = divmod(r["at"], d)
        v[a, b] = v[b, a] = (n * _joined(r) - rest[a] * rest[b]) / (n * n)
    return v


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with V = L L', columns in the order of the largest remaining diagonal; ends where only rounding is left."""
    d = len(v)
    left, rest = np.zeros((d, d)), v.diagonal().copy()
    least = d * np.finfo(float).eps * max(0.0, rest.max(initial=0.0))
    for k in range(d):
        p = int(rest.argmax())
        if rest[p] <= least:
            return left[:, :k]
        column = (v[:, p] - left[:, :k] @ left[p, :k]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0.0
        left[:, k] = column
        rest = rest - column**2
        rest[p] = -np.inf
    return left


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and components (rows) of L L' by rotating pairs of columns of L until all are orthogonal.

    Every round of a sweep takes disjoint pairs, all at once; a sweep meets each pair once.
    """
    a = np.ascontiguousarray(factor.T)
    r, d = a.shape
    seats = list(range(r + r % 2))
    limit = max(d, 8) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(p, q) for p, q in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1], strict=True) if max(p, q) < r]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            x, y = a[p], a[q]
            one, two, both = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            some = np.abs(both) > limit * np.sqrt(one * two)
            if not some.any():
                continue
            turned = True
            p, q, x, y = p[some], q[some], x[some], y[some]
            z = (two - one)[some] / (2 * both[some])
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if not turned:
            break
    norm = np.sqrt((a * a).sum(1))
    order = np.argsort(-norm, kind="stable")
    unit = a[order] / norm[order, None]
    # either sign is right; the largest entry is positive, so that a rerun gives the same rows
    sign = np.sign(unit[np.arange(r), np.abs(unit).argmax(1)]) if r else np.ones(0)
    return norm[order] ** 2, unit * sign[:, None]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of the column ``v``; None if there is no usable vector."""
    d, n, sums = totals(rows)
    if not n:
        return None
    v = covariance(rows, d, n, sums)
    values, directions = jacobi(pivoted_cholesky(v))
    trace = float(np.trace(v)) or 1.0
    k = min(components, len(values))
    return Fit(n, sums, values[:k], values[:k] / trace, directions[:k])


def _deviation(t: np.ndarray) -> list[Decimal | None]:
    """Sums of squares by row, exact; null where 38 digits do not hold them."""
    if len(t) and t.shape[1] * (int(np.abs(t).max()) + 1) ** 2 < 1 << 62:
        return [Decimal(v) for v in (t * t).sum(1).tolist()]
    found = [sum(v * v for v in row) for row in t.astype(object).tolist()]
    return [Decimal(v) if v < 10**38 else None for v in found]


def project(x: np.ndarray, f: Fit) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S (whole numbers; Python integers where a long could overflow) and the whitened rows."""
    middle = np.array([(2 * s + f.n) // (2 * f.n) for s in f.sums], np.int64)
    rest = [s - f.n * m for s, m in zip(f.sums, middle.tolist(), strict=True)]
    y = _centred(x, middle)
    small = f.n * (int(np.abs(y).max(initial=0)) + 2) < 1 << 62
    t = y * f.n - np.array(rest, np.int64) if small else y.astype(object) * f.n - np.array(rest, object)
    return t, (t / f.n).astype(float) @ f.directions.T / np.sqrt(f.values)


def whitened_rows(rows: DataFrame, f: Fit) -> DataFrame:
    """The columns of ``rows`` but ``v``, with deviation (decimal) and whitened (one entry per component)."""
    d, k = len(f.sums), len(f.values)
    kept = [c for c in rows.columns if c != "v"]
    schema = rows.select(*[col(c) for c in kept]).schema.add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))

    def each(batches):
        for batch in batches:
            length, start, flat = entries(batch["v"])
            t, w = project(whole(flat, start[length == d], d), f)
            own = batch.select(kept).filter(pa.array(length == d))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(_deviation(t), _WIDE), lists], [*kept, "deviation", "whitened"])

    return rows.mapInArrow(each, schema)


def identity_error(rows: DataFrame, f: Fit) -> float:
    """The largest entry of the whitened rows' covariance minus the identity: a pass of its own over all rows.

    Every batch is centred at its own mean before it is multiplied; means of batches are joined by their weights.
    """
    d, k = len(f.sums), len(f.values)

    def each(batches):
        n, mean, total = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            length, start, flat = entries(batch["v"])
            _, w = project(whole(flat, start[length == d], d), f)
            if not len(w):
                continue
            own = w.mean(0)
            w = w - own
            step, weight = own - mean, n * len(w) / (n + len(w))
            total += w.T @ w + weight * np.outer(step, step)
            mean, n = mean + step * len(w) / (n + len(w)), n + len(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.reshape(-1)), pa.array(np.outer(mean, mean).reshape(-1) * n), pa.array(np.repeat(mean, k) * n)], ["at", "own", "of_means", "sum"])

    parts = rows.mapInArrow(each, "at long, own double, of_means double, sum double")
    found = parts.groupBy("at").agg(F.sum("own").alias("own"), F.sum("of_means").alias("of_means"), F.sum("sum").alias("sum")).orderBy("at").collect()
    mean = np.array([r["sum"] for r in found]).reshape(k, k)[:, 0] / f.n
    cov = np.array([r["own"] + r["of_means"] for r in found]).reshape(k, k) / f.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the id column, component, n, deviation, whitened, explained, identity_error."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(col(id).alias("i"), col(vector).alias("v"))
    f = fit(rows.select("v"), components)
    if f is None or not len(f.values):
        return rows.limit(0).selectExpr(
            "i", "0 AS component", "0L AS n", "CAST(0 AS decimal(38,0)) AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error"
        ).withColumnRenamed("i", id)
    error = identity_error(rows.select("v"), f)
    shares = F.array(*[F.lit(float(e)) for e in f.explained])
    out = whitened_rows(rows, f).select("i", "deviation", F.posexplode("whitened").alias("k", "w"))
    return out.select(
        F.col("i").alias(id), (F.col("k") + 1).cast("int").alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
