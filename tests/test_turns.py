"""Turns by composition against a plain fold over the set of open turns."""

import random
from collections import defaultdict

import pytest

from tracelake.operators import state

ROWS = "file string, ord long, turn_id string, started boolean"


def plain(rows):
    out, open_ = {}, defaultdict(set)
    for file, at, turn, started in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        s, clear = open_[file], False
        if started:
            s.add(turn or f"o{at}")
        elif turn in s:
            s.discard(turn)
        else:
            s.clear()
            clear = True
        out[file, at] = (clear, len(s))
    return out


def check(spark, rows):
    got = state.scan_turns(spark.createDataFrame(rows, ROWS)).collect()
    assert {(r.file, r.ord): (r.is_clear, r.open_after) for r in got} == plain(rows)


@pytest.mark.parametrize("seed,span", [(1, 4096), (2, 7), (3, 3), (4, 1)])
def test_turns_equal_plain_fold(spark, monkeypatch, seed, span):
    monkeypatch.setattr(state, "TURN_SPAN", span)
    rng = random.Random(seed)
    rows = []
    for f in ["a", "b", "c", None]:
        turns = [None, *(f"t{k}" for k in range(rng.randint(2, 9)))]
        rows += [(f, k, rng.choice(turns), rng.random() < 0.55) for k in sorted(rng.sample(range(400), 120))]
    check(spark, rows)


def test_cascade_of_unknown_ends(spark, monkeypatch):
    """Each end is a clear only because the one before it is."""
    monkeypatch.setattr(state, "TURN_SPAN", 64)
    n = 1000
    rows = [("f", 0, "t0", True)]
    at = 1
    for k in range(n):
        if k == 0:
            rows.append(("f", at, "unknown", False))
        rows += [("f", at + 1, f"t{k + 1}", True), ("f", at + 2, f"t{k}", False)]
        at += 3
    check(spark, rows)


def test_no_ends_and_no_rows(spark):
    check(spark, [("f", 1, "a", True), ("f", 2, None, True)])
    check(spark, [])
