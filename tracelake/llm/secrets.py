"""Secret scan with a random forest that takes out false findings.

Candidates are runs of characters that keys, tokens and passwords are made of, and every value that is assigned to a
name such as ``password``, whatever its length, case and signs.  A candidate is described by its length,
the kinds of its characters, how likely its character transitions are in the corpus, how much of it dictionary words
cover, where it stands in the text and in its source, and hashed neighbouring words.  A forest of decision
trees, grown here in numpy on labelled findings, decides.

Labelled findings are a parameter.  Without them, findings are labelled by form on a bounded sample: a value assigned to
a name such as ``password``, or behind the prefix of a key format, is a secret; addresses, plain numbers and dates are
not; what neither rule settles is not learned from.

Transitions and dictionary are counts over all documents.  A null text has no candidates.  Repeated rows give repeated
findings; an empty table gives none.  Without labels of both kinds every candidate is a finding with score 1.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, empty_if_null

#: Labelled candidates that the forest is grown on at most, its trees, their depth, and dictionary words.
TRAIN_ROWS, TREES, DEPTH, DICTIONARY = 8000, 25, 8, 20_000
THRESHOLD = 0.5
LEAST = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-=.:@]{%d,}" % LEAST)
_NEAR = re.compile(r"\w+")
#: Fixed values of the labelling by form: names of secret values, prefixes of key formats, and harmless forms.
_ASSIGNED = r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key)[\"']?\s*[:=]+\s*"
ASSIGNED, NAMED = re.compile(_ASSIGNED), re.compile(_ASSIGNED + r"[\"']?$")
QUOTED = re.compile(r"""(["'])((?:(?!\1)[^\\\n]|\\.)*)\1""")
PREFIXES = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk-|AIza|glpat-)")
HARMLESS = re.compile(r"[\d.:/\-]+|[\w.+\-]+@[\w.\-]+|https?[:/].*|[a-z.\-:=]+|[A-Z.\-:=]?[a-z.\-:=]+")
NEIGHBOURS = 16
FEATURES = 13 + 2 * NEIGHBOURS


class Background(NamedTuple):
    """Log probabilities of byte transitions (128 x 128) and the dictionary words of the corpus."""

    moves: np.ndarray
    words: frozenset


def assigned(text: str) -> list[tuple[int, int, int]]:
    """(start of the name, start and stop of the value) of each value that is not blank and is assigned to such a name."""
    out = []
    done, m = 0, ASSIGNED.search(text)
    while m:
        name, start = m.start(), m.end()
        while name > done and (text[name - 1].isalnum() or text[name - 1] in "_-"):
            name -= 1
        if quoted := QUOTED.match(text, start):
            start, stop = quoted.span(2)
            after = ASSIGNED.search(text, quoted.end())
        else:
            start += text[start : start + 1] in ("'", '"')
            stop = start
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            after = ASSIGNED.search(text, start)
            if after and after.start() < stop:  # a name inside the value has a value of its own
                stop = after.start()
            bare = text[start:stop].rstrip(".,;:)]}>\"'")
            stop = start + len(bare) if bare else stop
        if text[start:stop].strip():
            out.append((name, start, stop))
            done = stop
        m = after
    return out


def candidates(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, stop, value, text before, text behind) of each assigned value, and of each other run with a digit or mixed case."""
    text, out, at = text or "", [], 0
    for name, start, stop in [*assigned(text), (len(text), 0, 0)]:
        for m in CANDIDATE.finditer(text, at, name):
            begin, value = m.start(), m[0].rstrip(".:=")
            if "=" in value and (cut := value.index("=") + 1) < len(value) and value[: cut - 1].isidentifier():
                begin, value = begin + cut, value[cut:].lstrip("=")  # a name and its value
                begin = m.start() + m[0].index(value, cut) if value else begin
            if len(value) >= LEAST and (any(c.isdigit() for c in value) or value != value.lower() and value[1:] != value[1:].lower()):
                out.append((begin, begin + len(value)))
        if stop:
            out.append((start, stop))
            at = stop
    return [(a, b, text[a:b], text[max(0, a - 40) : a], text[b : b + 40]) for a, b in out]


def _bucket(word: str) -> int:
    h = 2166136261
    for b in word.lower().encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % NEIGHBOURS


def describe(found: tuple[int, int, str, str, str], size: int, source: str, back: Background) -> list[float]:
    start, _, value, before, behind = found
    n = len(value)
    raw = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
    digits, upper, lower = sum(c.isdigit() for c in value), sum(c.isupper() for c in value), sum(c.islower() for c in value)
    counts = np.bincount(raw)
    p = counts[counts > 0] / n
    parts = re.findall(r"[A-Za-z]{3,}", value)
    covered = sum(len(w) for w in parts if w.lower() in back.words)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    near = [0.0] * (2 * NEIGHBOURS)
    for k, word in enumerate(reversed(_NEAR.findall(before)[-2:])):
        near[_bucket(word)] = 1.0 / (k + 1)
    for word in _NEAR.findall(behind)[:1]:
        near[NEIGHBOURS + _bucket(word)] = 1.0
    return [
        n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, float(-(p * np.log2(p)).sum()), float(back.moves[raw[:-1], raw[1:]].mean()) if n > 1 else 0.0, covered / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(value.count("@") + value.count(".")), float(before[-1:] in "\"'=:" and before != ""), start / max(1, size), float(_bucket(source)),
        *near,
    ]


def label_by_form(found: tuple[int, int, str, str, str]) -> int | None:
    _, _, value, before, _ = found
    if NAMED.search(before) or PREFIXES.match(value):
        return 1
    return 0 if HARMLESS.fullmatch(value) else None


# --- forest -------------------------------------------------------------------------------------------------------


class Tree(NamedTuple):
    """Nodes in heap order: feature (-1 for a leaf), threshold, children, share of secrets."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 3) -> Tree:
    nodes: list[list] = []
    todo = [(rng.integers(0, len(y), len(y)), 0, -1, 0)]
    while todo:
        rows, level, parent, side = todo.pop()
        k = len(nodes)
        share = (y[rows].sum() + 1) / (len(rows) + 2)
        nodes.append([-1, 0.0, 0, 0, share])
        if parent >= 0:
            nodes[parent][2 + side] = k
        if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            continue
        best = (0.0, -1, 0.0)
        total = y[rows].sum()
        base = total * (1 - total / len(rows))
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 2), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], y[rows][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
            if not len(cut):
                continue
            a, n = np.cumsum(t)[cut], cut + 1
            b, m = total - a, len(rows) - n
            gain = base - a * (1 - a / n) - b * (1 - b / m)
            if gain.max() > best[0]:
                at = cut[gain.argmax()]
                best = (float(gain.max()), int(f), float((v[at] + v[at + 1]) / 2))
        if best[1] >= 0:
            nodes[k][0], nodes[k][1] = best[1], best[2]
            go = x[rows, best[1]] <= best[2]
            todo += [(rows[go], level + 1, k, 0), (rows[~go], level + 1, k, 1)]
    cols = list(zip(*nodes, strict=True))
    return Tree(*[np.array(c) for c in cols])


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [_grow(x, y, rng, depth) for _ in range(trees)] if len(y) and 0 < y.sum() < len(y) else []


def vote(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean share of secrets over the trees; 1 without trees."""
    if not forest or not len(x):
        return np.ones(len(x))
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := t.feature[at] >= 0).any():
            f = np.maximum(t.feature[at], 0)
            nxt = np.where(x[np.arange(len(x)), f] <= t.limit[at], t.left[at], t.right[at])
            at = np.where(inner, nxt, at)
        total += t.share[at]
    return total / len(forest)


# --- over tables --------------------------------------------------------------------------------------------------


def background(docs: DataFrame, text: str = "text", dictionary: int = DICTIONARY) -> Background:
    """Counts over all documents: transitions of ASCII characters (a table of 128 x 128) and the commonest words."""

    def moves(batches):
        total = np.zeros(1 << 14, np.int64)
        for batch in batches:
            for t in batch["text"]:
                raw = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8).astype(np.int64)
                pair = raw[:-1] * 128 + raw[1:]
                total += np.bincount(pair[(raw[:-1] < 128) & (raw[1:] < 128)], minlength=1 << 14)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k, "n": total[k]})

    def words(batches):
        from collections import Counter

        for batch in batches:
            count = Counter(w for t in batch["text"] for w in re.findall(r"[a-z]{3,}", (t or "").lower()))
            yield pd.DataFrame({"w": list(count), "n": list(count.values())})

    body = docs.select(col(text).cast("string").alias("text"))
    table = np.ones(1 << 14)
    for r in body.mapInPandas(moves, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        table[r["k"]] += r["n"]
    table = table.reshape(128, 128)
    common = body.mapInPandas(words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(dictionary)
    return Background(np.log(table / table.sum(axis=1, keepdims=True)), frozenset(r["w"] for r in common.collect()))


FOUND = "array<struct<start:long,stop:long,value:string,label:int,score:double>>"


def findings(text: Column, source: Column, back: Background, forest: list[Tree] | None) -> Column:
    """Candidates of a text with score; ``label`` is that by form, -1 where it settles nothing."""

    def scan(texts: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for t, src in zip(texts, sources, strict=True):
            found = candidates(t)
            x = np.array([describe(f, len(t), src or "", back) for f in found]).reshape(-1, FEATURES)
            # without labelled findings of both kinds there is no forest: the form alone decides
            score = vote(forest, x) if forest else np.array([float(label_by_form(f) == 1) for f in found])
            rows = []
            for f, p in zip(found, score.tolist(), strict=True):
                label = label_by_form(f)
                rows.append({"start": f[0], "stop": f[1], "value": f[2], "label": -1 if label is None else label, "score": round(p, 6)})
            out.append(rows)
        return pd.Series(out)

    return F.pandas_udf(scan, FOUND)(text.cast("string"), source)


def train(docs: DataFrame, back: Background, id: str = "doc_id", text: str = "text", source: str = "source", labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> list[Tree]:
    """Grow the forest on at most ``rows`` candidates, those first in hash order.

    labelled: findings (id, start, secret 0/1); without it, labels by form.
    """

    def described(texts: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for t, src in zip(texts, sources, strict=True):
            out.append([{"start": f[0], "label": -1 if (k := label_by_form(f)) is None else k, "x": describe(f, len(t), src or "", back)} for f in candidates(t)])
        return pd.Series(out)

    each = F.pandas_udf(described, "array<struct<start:long,label:int,x:array<double>>>")(col(text).cast("string"), empty_if_null(col(source)))
    found = docs.select(col(id).alias("i"), F.explode(each).alias("f")).select("i", "f.start", "f.label", "f.x")
    if labelled is not None:
        known = labelled.select(col(id).alias("i"), "start", col("secret").cast("int").alias("label"))
        found = found.drop("label").join(known, ["i", "start"])
    sample = found.where("label >= 0").orderBy(F.xxhash64("i", "start"), "i", "start").limit(rows).select("label", "x").collect()
    x, y = np.array([r["x"] for r in sample]).reshape(-1, FEATURES), np.array([float(r["label"]) for r in sample])
    return grow(x, y)


def scanned(docs: DataFrame, back: Background, forest: list[Tree], text: str = "text", source: str = "source", as_: str = "findings") -> DataFrame:
    """``docs`` with an array ``as_`` of the findings of each text."""
    return docs.withColumn(as_, findings(col(text), empty_if_null(col(source)), back, forest))
