"""Quality rules as a learned decision list: sequential covering over threshold conjunctions.

Statistics of every text are counted once.  On a bounded sample of labelled rows one rule after the other is grown
(conditions ``statistic <= t`` or ``statistic > t`` with the best information gain, until no good row is covered), then
pruned from its end on rows it was not grown on, and taken if it is right often enough there; rows that it covers leave.
The list becomes one ordered Spark conditional expression: the first rule that holds rejects the row, and the last arm
keeps it.

Words are split at ASCII white space (blank, tab to carriage return).  A null text has no words.  Labels that are null,
contradict each other or have no document are not learned from; without labels of both kinds there are no rules, and only
the base conditions reject.  Repeated rows are judged alike; of rows that share an id, one is learned from.  An empty table
gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, give_back, others, small_batches, stash, unused

#: Labelled rows that the list is learned from at most (chosen by a hash of the id).
TRAIN_ROWS = 10_000
#: A rule stays if, of the rows it covers beyond those it was grown on, at least this share is bad.
PRECISION = 0.8
#: Words that a text must have, and the share of repeated words (in percent) that it may have.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks"]
#: What rules are made of: a count, and the count it is divided by (none: as it is).
STATISTICS = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "lower_share": ("n_lower", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}
_PART, _SLICES = 1 << 20, 1 << 20
_SPACES = [9, 10, 11, 12, 13, 32]


class Condition(NamedTuple):
    statistic: str
    above: bool
    threshold: float


Rule = list[Condition]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs twice or more."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(ids) - width + 1
    key, span = ids[:n], len(known)
    for k in range(1, width):
        if span * len(known) >= 1 << 62:
            key, span = np.unique(key, return_inverse=True)[1], n
        key, span = key * len(known) + ids[k : k + n], span * len(known)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    kinds = np.zeros(256, np.int64)
    for at in range(0, len(raw), _PART):
        kinds += np.bincount(np.frombuffer(raw, np.uint8, min(_PART, len(raw) - at), at), minlength=256)
    chars = int(kinds.sum() - kinds[0x80:0xC0].sum() - kinds[_SPACES].sum())
    lines = [s for s in raw.split(b"\n") if s.strip()]
    return (
        len(words), chars, int(kinds[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        int(kinds[ord("A") : ord("Z") + 1].sum()), int(kinds[ord("a") : ord("z") + 1].sum()), int(kinds[ord("0") : ord("9") + 1].sum()), int(kinds[ord("!")] + kinds[ord("?")]),
    )


def with_counts(docs: DataFrame, text: str = "text", as_: str = "counts") -> DataFrame:
    """``docs`` with a struct of ``COUNTS``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([counts(t) for t in texts], columns=COUNTS, dtype="int64")
        give_back()
        return out

    return docs.withColumn(as_, count(col(text).cast("string")))


def statistic(name: str, of: str = "counts") -> Column:
    over, under = STATISTICS[name]
    value = F.col(f"{of}.{over}").cast("double")
    return value if under is None else F.when(F.col(f"{of}.{under}") == 0, F.lit(0.0)).otherwise(value / F.col(f"{of}.{under}"))


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= (x[c.statistic] > c.threshold) == c.above
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest gain over the rows: bad rows it keeps, times the bits that it tells of each."""
    n, p = len(bad), int(bad.sum())
    if not p:
        return 0.0, None
    before, best = np.log2(p / n), (1e-9, None)
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s = v[order]
        cut = np.flatnonzero(s[1:] > s[:-1]) + 1
        if not len(cut):
            continue
        low_p = np.cumsum(bad[order])[cut - 1]
        for above, kept_p, kept_n in ((False, low_p, cut), (True, p - low_p, n - cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(kept_p > 0, kept_p * (np.log2(kept_p / kept_n) - before), 0.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, above, _between(s[cut[k] - 1], s[cut[k]])))
    return best


def _between(low: float, high: float) -> float:
    """The shortest number that parts the two: low <= t < high."""
    for digits in range(1, 17):
        t = float(f"{(low + high) / 2:.{digits}g}")
        if low <= t < high:
            return t
    return float(low)


def _only(x: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in x.items()}


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = []
    while len(bad) and not bad.all():
        _, found = _best(x, bad)
        if found is None:
            break
        rule.append(found)
        inside = covers([found], x)
        x, bad = _only(x, inside), bad[inside]
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on; of equals the shortest."""

    def worth(k: int) -> float:
        inside = covers(rule[:k], x)
        p = int(bad[inside].sum())
        return (2 * p - inside.sum()) / max(1, inside.sum())

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """The decision list for rows in an order that has nothing to do with what they are; every third one prunes."""
    rules: list[Rule] = []
    bad = np.asarray(bad, bool)
    while bad.any() and not bad.all():
        own = np.arange(len(bad)) % 3 != 2
        rule = prune(grow(_only(x, own), bad[own]), _only(x, ~own), bad[~own])
        inside = covers(rule, x) if rule else np.zeros(len(bad), bool)
        away = inside & ~own
        right = (bad[away].sum() + 1) / (away.sum() + 2) if away.any() else 0.0
        if not (bad & inside).any() or right < min(precision, (away.sum() + 1) / (away.sum() + 2)):
            break
        rules.append(rule)
        x, bad = _only(x, ~inside), bad[~inside]
    return rules


def condition(c: Condition, of: str = "counts") -> Column:
    value = statistic(c.statistic, of)
    return value > F.lit(c.threshold) if c.above else value <= F.lit(c.threshold)


def verdict(rules: list[Rule], of: str = "counts") -> Column:
    """True for rows that no rule rejects: an ordered conditional expression, one arm per rule."""
    arms = None
    for rule in rules:
        both = F.lit(True)
        for c in rule:
            both = both & condition(c, of)
        arms = F.when(both, F.lit(False)) if arms is None else arms.when(both, F.lit(False))
    return F.lit(True) if arms is None else arms.otherwise(F.lit(True))


def base_failed(of: str = "counts") -> Column:
    n, repeated = F.col(f"{of}.n_words"), F.col(f"{of}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def train(counted: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS, of: str = "counts", precision: float = PRECISION) -> list[Rule]:
    """The list learned from at most ``rows`` labelled documents, those whose ids come first in hash order.

    counted: rows with the id and the struct of ``with_counts``.  A label of 0 is bad.  Rows that fail the base conditions
    are left out, as the rules never decide about them.
    """
    wanted = labels.select(col(id).alias("i"), col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    wanted = wanted.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("i", "y", F.xxhash64("i").alias("h"))
    # the hash alone first leaves a few times what is wanted, so that no task hands on ``rows`` rows of its own
    share = min(_SLICES, _SLICES * 4 * rows // max(1, wanted.count()) + 1)
    wanted = wanted.where(F.pmod("h", F.lit(_SLICES)) < share)
    own = counted.select(col(id).alias("i"), col(of).alias("c")).where(~base_failed("c"))
    own = own.join(wanted, "i").groupBy("h", "i").agg(F.min("y").alias("y"), F.min("c").alias("c")).orderBy("h", "i").limit(rows)
    sample = own.select("h", "i", "y", *[statistic(s, "c").alias(s) for s in STATISTICS]).collect()
    sample.sort(key=lambda r: (r["h"], r["i"]))
    if not sample:
        return []
    return learn({s: np.array([r[s] for r in sample]) for s in STATISTICS}, np.array([r["y"] == 0 for r in sample]), precision)


def judged(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", carry: list[str] | None = None) -> tuple[DataFrame, list[Rule]]:
    """The columns ``carry`` (default: all) of every row with the first five counts, base_failed and kept; and the rules.

    An input column with the name of a new one gives way to it.
    """
    carry = others(list(docs.columns) if carry is None else carry, [*COUNTS[:5], "base_failed", "kept"])
    names = {c: unused(docs, f"_dl{k}") for k, c in enumerate(carry)}
    rows = with_counts(docs.select(*[col(c).alias(names[c]) for c in carry], col(id).alias("_dl_id"), col(text).alias("_dl_text")), "_dl_text", "_dl_counts")
    rows = stash(rows.drop("_dl_text"), "rule-counts")
    own = labels.select(col(id).alias("_dl_id"), col(label).alias("_dl_label"))
    rules = train(rows, own, "_dl_id", "_dl_label", of="_dl_counts")
    failed = base_failed("_dl_counts")
    out = rows.select(
        *[col(names[c]).alias(c) for c in carry], *[F.col(f"_dl_counts.{c}").alias(c) for c in COUNTS[:5]], failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(verdict(rules, "_dl_counts")).alias("kept"),
    )
    return out, rules
