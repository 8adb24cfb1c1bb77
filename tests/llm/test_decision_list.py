"""Quality rules: counts against a plain count, the learner on known rules, verdicts against Python's."""

import random
import re

import numpy as np

from tests.llm.helpers import DOCS, EXTRA, documents, prose, with_extra
from tracelake.llm import decision_list as dl

SPACES = r"[\x20\x09-\x0D]"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = set()
    for k, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= {k, k + 1, k + 2}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_plain_counts():
    texts = [None, "", " \n\t", "a a a a", "a b c d a b c", "one\none\n one\n\n\none", "é中\U0001f600 x\xa0y z\x1cw \x85", "#*$%&|<> x\r\nx\r\nx", "w " * 40]
    rng = random.Random(1)
    texts += ["".join(rng.choices("ab \n\t#é", k=rng.randint(0, 120))) for _ in range(200)]
    texts.append(" ".join(rng.choices(["x", "y", "z"], k=500)))
    for t in texts:
        assert dl.counts(t)[:5] == plain(t), t
    long = "word again and again\n" * 200_000
    assert dl.counts(long)[:5] == (800_000, 3_400_000, 0, 199_999, 800_000)
    old, words = dl.repeated_words, [str(k % 700) for k in range(3000)]
    assert old([w.encode() for w in words]) == plain(" ".join(words))[4]


def bad_text(rng):
    kind = rng.randint(0, 2)
    if kind == 0:
        return prose(rng, rng.randint(60, 90)).upper() + "!"
    if kind == 1:
        return " ".join(w + "###" for w in prose(rng, rng.randint(60, 90)).split())
    return " | ".join(prose(rng, rng.randint(60, 90)).split())


def test_judged(spark):
    rng = random.Random(4)
    rows, labels = documents(3, 30), []
    for k in range(1000, 1400):
        bad = rng.random() < 0.4
        rows.append((k, bad_text(rng) if bad else prose(rng, rng.randint(60, 120)), "en", "s", 1))
        if k < 1300:
            labels.append((k, int(not bad), 0))
    truth = {r[0]: re.search(r"###|\|", r[1]) is None and not r[1].isupper() for r in rows if (r[0] or 0) >= 1000}
    labels += [(1000, 1, 0), (1000, 0, 0), (None, 0, 0), (1001, None, 0), (77777, 0, 1)]
    docs = spark.createDataFrame(with_extra(rows), DOCS + EXTRA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, rules = dl.judged(docs, lab)
    assert rules and got.columns.count("kept") == 1 and "a.b" in got.columns
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        n, c, s, d, w = plain(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, c, s, d, w)
        assert r.base_failed == (n < 50 or 100 * w > 50 * n)
        values = dict(zip(dl.COUNTS, dl.counts(r.text), strict=True))
        stat = {k: np.array([values[a] if b is None else values[a] / values[b] if values[b] else 0.0]) for k, (a, b) in dl.STATISTICS.items()}
        assert r.kept == (not r.base_failed and not any(dl.covers(rule, stat)[0] for rule in rules))
    held = [(r.kept, truth[r.doc_id]) for r in out if (r.doc_id or 0) >= 1300]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    # labels of one kind, no labels, no documents
    for few in (lab.where("quality = 1"), lab.limit(0)):
        got, rules = dl.judged(docs, few, carry=["doc_id"])
        assert rules == [] and got.where("kept = base_failed").count() == 0
    assert dl.judged(docs.limit(0), lab)[0].count() == 0


def test_learner_finds_ordered_rules():
    rng = np.random.default_rng(2)
    x = {"words": rng.integers(0, 100, 900).astype(float), "upper_share": rng.random(900), "marks_per_word": rng.random(900)}
    bad = (x["upper_share"] > 0.7) & (x["words"] > 50) | (x["marks_per_word"] <= 0.1)
    rules = dl.learn(x, bad)
    found = np.zeros(900, bool)
    for r in rules:
        found |= dl.covers(r, x)
    assert (found == bad).mean() > 0.97 and len(rules) <= 8
    assert dl.learn(x, np.zeros(900, bool)) == [] and dl.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []
    noise = rng.random(900) < 0.05
    assert sum(len(r) for r in dl.learn({"words": rng.random(900)}, noise)) <= 2
