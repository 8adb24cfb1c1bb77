"""Quality by hierarchical empirical Bayes: a document classifier's evidence and posteriors of host and path.

A logistic model on the document alone (how it is written, and hashed words) is trained here from a bounded
sample of labelled rows.  Its probabilities are summed over all documents by host and by path below the host.
The global rate is the prior of every host, the host's posterior the prior of its paths; the weight of a prior
is estimated from how much the groups differ beyond what their sizes explain (moments of the beta-binomial),
so sparse sites shrink to the rate above them.  A document's score is its own evidence (log odds beyond the rate
in the sample) on top of the log odds of its path.

Sums are of whole millionths, so results do not depend on the order of rows.  A null text counts as empty; a
null host or path is a group of its own.  Labels that are null, repeated with different values or without a
document are not learned from; without labels of both kinds the evidence is zero everywhere and all rows stay.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, empty_if_null, give_back, stash, unused

#: Labelled rows that the model is fitted on at most (chosen by a hash of the id), and hash buckets of words.
TRAIN_ROWS, BUCKETS = 5000, 1 << 14
THRESHOLD = 0.5
#: Site tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
_UNIT = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
#: Characters whose features are computed at a time.
PART_CHARS = 250_000
_SPACE = np.zeros(256, bool)
_SPACE[[0, *range(9, 14), 32]] = True
STATS = 10


def _class(lo: str, hi: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord(lo) : ord(hi) + 1] = True
    return out


_UPPER, _LOWER, _DIGIT = _class("A", "Z"), _class("a", "z"), _class("0", "9")
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _SPACE)
_SIGN[128:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, base, np.uint64))) for base in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (rows x STATS) and the distinct (row, bucket) pairs of the words of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = b"\0".join(raw) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    n = len(raw)
    edge = np.cumsum([0] + [len(r) + 1 for r in raw])

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), edge[:-1]).astype(float)

    size = np.maximum(1, np.diff(edge) - 1).astype(float)
    word = ~_SPACE[data]
    change = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = change[::2], change[1::2]
    folded = np.where(_SIGN[data], 0, _FOLD[data]).astype(np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    # signs are left out of a word, so that it is the same word before a comma
    letter = ~_SIGN[data] & word
    order = np.cumsum(letter)
    up, down = _power_tables(len(data) + 1)
    np.cumsum(np.where(letter, folded * up[order], np.uint64(0)), out=total[1:])
    before = np.concatenate([[0], order])
    h = (total[ends] - total[starts]) * down[before[starts]]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    doc = np.searchsorted(edge, starts, side="right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(1, words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    by = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
    distinct = np.bincount(doc[by][new], minlength=n)
    pair = np.unique(doc[by][new].astype(np.int64) * BUCKETS + (h[by][new] % np.uint64(BUCKETS)).astype(np.int64))
    signs = per_doc(_SIGN[data])
    # how the distinct words thin out in a normal text: about with the square root of its length
    stats = np.stack(
        [
            per_doc(_UPPER[data]) / size, per_doc(_DIGIT[data]) / size, signs / size, per_doc(data >= 128) / size, per_doc(_LOWER[data]) / size,
            np.log1p(words), distinct / some, np.log1p(distinct) - 0.75 * np.log1p(words), np.bincount(doc[same], minlength=n) / some, np.minimum(signs / some, 5),
        ],
        axis=1,
    )
    return stats, pair // BUCKETS, pair % BUCKETS


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    stats: np.ndarray
    words: np.ndarray
    bias: float
    rate: float

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of each text beyond the rate in the sample."""
        out = np.zeros(len(texts))
        at, k = 0, 0
        while at < len(texts):  # bounded memory: some MB of text at a time
            size, k = 0, at
            while k < len(texts) and (k == at or size < PART_CHARS):
                size += len(texts[k] or "")
                k += 1
            x, row, bucket = features(texts[at:k])
            z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.stats + self.bias
            count = np.maximum(1, np.bincount(row, minlength=k - at))
            z += np.bincount(row, weights=self.words[bucket], minlength=k - at) / np.sqrt(count)
            out[at:k] = z - math.log(self.rate / (1 - self.rate))
            at = k
        return out


def described(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Statistics and distinct buckets of each text."""
    stats, buckets = [], []
    for at in range(0, len(texts), 50):
        x, row, bucket = features(texts[at : at + 50])
        stats.append(x)
        buckets += np.split(bucket, np.searchsorted(row, np.arange(1, len(x))))
    return np.concatenate(stats) if stats else np.zeros((0, STATS)), buckets


def fit(texts: list[str | None], good: np.ndarray, **options) -> Model | None:
    return fit_features(*described(texts), good, **options)


def fit_features(x: np.ndarray, buckets: list[np.ndarray], good: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model | None:
    """Logistic regression by Adam on the whole sample; None unless both kinds are there."""
    if not 0 < good.sum() < len(good):
        return None
    n = len(x)
    row, bucket = np.repeat(np.arange(n), [len(b) for b in buckets]), np.concatenate(buckets).astype(np.int64)
    count = np.maximum(1, np.bincount(row, minlength=n))
    value = 1 / np.sqrt(count[row])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.clip((x - mean) / scale, -8, 8)
    base = good.mean()
    theta = [np.zeros(x.shape[1]), np.zeros(BUCKETS), np.array([math.log(base / (1 - base))])]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        z = x @ theta[0] + np.bincount(row, weights=theta[1][bucket] * value, minlength=n) + theta[2]
        off = (1 / (1 + np.exp(-z)) - good) / n
        grads = [x.T @ off + decay * theta[0], np.bincount(bucket, weights=off[row] * value, minlength=BUCKETS) + decay * theta[1], np.array([off.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], float(theta[2][0]), float(base))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents, those whose ids come first in hash order.

    The texts are described where they are; only their statistics and buckets reach the driver.
    """
    wanted = labels.select(col(id).alias("i"), col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    wanted = wanted.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").orderBy(F.xxhash64("i"), "i").limit(rows)
    body = docs.select(col(id).alias("i"), col(text).cast("string").alias("t"))

    def describe(texts: pd.Series) -> pd.DataFrame:
        x, buckets = described(list(texts))
        return pd.DataFrame({"x": list(x), "buckets": [b.astype(np.int32) for b in buckets]})

    found = body.join(F.broadcast(wanted.select("i", "y")), "i").limit(2 * rows)
    found = found.select("i", "y", F.pandas_udf(describe, "x array<double>, buckets array<int>")("t").alias("d"))
    sample = sorted(found.select("i", "y", "d.x", "d.buckets").collect(), key=lambda r: (r["i"], r["x"]))
    if not sample:
        return None
    model = fit_features(np.array([r["x"] for r in sample]), [np.array(r["buckets"], np.int64) for r in sample], np.array([r["y"] > 0 for r in sample], float))
    del sample
    give_back()
    return model


def evidence(text: Column, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(np.round(model.evidence(list(texts)), 6))
        give_back()
        return out

    return score(text.cast("string"))


class Sites(NamedTuple):
    """Posterior rates: of all documents, and by (host, path)."""

    rate: float
    paths: DataFrame
    n_paths: int


def _strength(groups: DataFrame, prior: Column) -> float:
    """The weight of the prior, in documents, by moments: how far group rates lie apart beyond chance."""
    mean = F.col("good") / F.col("n") / _UNIT
    chance = prior * (1 - prior)
    r = groups.agg(
        F.sum(F.round(F.col("n") * (mean - prior) ** 2 * _UNIT).cast("decimal(38,0)")).alias("apart"), F.sum(F.round(chance * _UNIT).cast("decimal(38,0)")).alias("chance"),
        F.sum(F.round(F.col("n") * chance * _UNIT).cast("decimal(38,0)")).alias("all"),
    ).first()
    if not r["all"]:
        return 1.0
    # E[n (mean - prior)^2] = chance + (n - 1) * chance * f, with f = 1 / (strength + 1)
    f = max(1e-6, float(r["apart"] - r["chance"]) / max(1.0, float(r["all"] - r["chance"])))
    return min(1e6, max(1.0, 1 / f - 1))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def sites(scored: DataFrame, model_rate: float, evidence: str = "evidence", host: str = "host", path: str = "path") -> Sites:
    """Posterior rates of hosts and paths from all rows."""
    p = 1 / (1 + F.exp(-(col(evidence) + math.log(model_rate / (1 - model_rate)))))
    rows = scored.select(col(host).alias("h"), col(path).alias("p"), F.round(p * _UNIT).cast("long").alias("good"))
    paths = rows.groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    paths = stash(paths, "site-counts")
    n_paths = paths.count()
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (float(whole["good"] or 0) / _UNIT + 1) / ((whole["n"] or 0) + 2)
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("h").alias("of"), ((F.col("good") / _UNIT + k * rate) / (F.col("n") + k)).alias("host_rate"))
    joined = paths.join(hosts, F.col("h").eqNullSafe(F.col("of"))).select("h", "p", "n", "good", "host_rate")
    k = _strength(joined, F.col("host_rate"))
    joined = joined.select("h", "p", "host_rate", ((F.col("good") / _UNIT + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))
    return Sites(rate, joined, n_paths)


def decide(scored: DataFrame, found: Sites, threshold: float = THRESHOLD, evidence: str = "evidence", host: str = "host", path: str = "path") -> DataFrame:
    """``scored`` with host_rate, path_rate, score (0 to 1) and kept."""
    table = F.broadcast(found.paths) if found.n_paths <= BROADCAST_ROWS else found.paths
    h, p = unused(scored, "_h"), unused(scored, "_p")
    table = table.select(F.col("h").alias(h), F.col("p").alias(p), "host_rate", "path_rate")
    rows = scored.join(table, col(host).eqNullSafe(F.col(h)) & col(path).eqNullSafe(F.col(p)), "left").drop(h, p)
    score = 1 / (1 + F.exp(-(col(evidence) + _odds(F.col("path_rate")))))
    return rows.withColumn("score", F.round(score, 6)).withColumn("kept", F.col("score") >= threshold)


def graded(docs: DataFrame, model: Model | None, text: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """``docs`` with the columns evidence, host and path; the names must be free."""
    host = empty_if_null(col("source")) if host is None else host
    path = F.concat_ws("/", host, empty_if_null(col("lang"))) if path is None else path
    return docs.withColumns({"evidence": evidence(col(text), model), "host": host, "path": path})


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns as they are."""
    model = train(docs, labels)
    if model is None:
        return docs
    names = {c: f"_q{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select(*[col(c).alias(n) for c, n in names.items()])
    part = lambda c: empty_if_null(col(names[c])) if c in names else F.lit("")
    rows = stash(graded(inner, model, names["text"], part("source"), F.concat_ws("/", part("source"), part("lang"))), "graded-documents")
    kept = decide(rows, sites(rows, model.rate), threshold).where("kept")
    return kept.select(*[col(n).alias(c) for c, n in names.items()])
