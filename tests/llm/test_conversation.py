"""Conversation repair against an exhaustive search, also where a conversation spreads over many range parts."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracelake.llm import conversation as cv

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def best_edits(turns):
    """(cost, audit, repaired turns) of the cheapest edits, ASCII-least; turns: (role, text, must go, truncated)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    @functools.cache
    def go(i, last, inserted):
        found = []
        if i == len(turns) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for k in "ua":
                if (last, k) in after:
                    c, a, out = go(i, k, inserted + 1)
                    found.append((c + 2, "I" + a, ((name[k], ""), *out)))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            c, a, out = go(i + 1, last, 0)
            found.append((c + 3, "D" + a, out))
            if not gone:
                if (last, role[:1]) in after:
                    c, a, out = go(i + 1, role[:1], 0)
                    found.append((c + cut, "K" + a, ((role, text), *out)))
                for k in "ua":
                    if (last, k) in after:
                        c, a, out = go(i + 1, k, 0)
                        found.append((c + 2 + cut, "R" + a, ((name[k], text), *out)))
        return min(found, default=(10**9, "", ()))

    return go(0, "", 0)


def plain(rows):
    """The contract's columns by conversation from damaged rows."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r, x, t))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda v: v[:4])
        seen, turns, count = set(), [], defaultdict(int)
        for _, _, r, x, _ in own:
            end = x.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((r, x))
            count[fault] += 1
            turns.append((r, x, fault in ("blank", "duplicate"), fault == "truncated"))
        nums = [t for *_, t in own if t is not None]
        gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
        pairs = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, fixed = best_edits(tuple(turns))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], pairs, cost, audit, sha)
    return out


def damage(rows):
    out = []
    for c, t, r, x in rows:
        one = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        r, x = one(r), one(x)
        if k:
            x = "" if k == 1 else x.translate(str.maketrans("", "", ".!?")) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def check(spark, rows, ddl=ROWS):
    df = spark.createDataFrame(rows, ddl)
    got = cv.repair(cv.damaged(df), df).collect()
    short = [r[:4] for r in rows]
    want = plain(damage(short))
    assert len(got) == len({r[0] for r in short})
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want.get(r.conv_id, EMPTY), r
    return got


def some_rows(seed, n, convs):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "Yes.", "No", "Why? ", "ok!\n", "a. b", "é中.", "\xa0", "x" * 300 + ".", "long " * 40]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "summary", "USER"]
    return [(rng.choice([*range(convs), None]), rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_repair_equals_exhaustive_search(spark):
    rows = some_rows(1, 160, 40)
    rows += [(900, k, "user" if k % 2 else "assistant", f"turn {k}.") for k in range(12)] + [(901, 0, "system", "only.")]
    check(spark, [*rows, *rows[:5]])
    # extra columns with names that are used inside
    check(spark, [(*r, "x", 1, "y") for r in rows[:60]], ROWS + ", c string, seq int, audit string")


def test_conversation_in_many_parts(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]), rng.choice(["A.", "B", " ", f"t{k}.", f"t{k}"])) for k in range(180)]
    rows += some_rows(2, 60, 12)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        light = cv.turns(cv._shape(spark.createDataFrame(rows, ROWS), "conv_id", "turn", "role", "text"))
        assert light.where("c = 7").select("part").distinct().count() >= 5
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_table_and_one_large_conversation(spark):
    df = spark.createDataFrame([], ROWS)
    assert cv.repair(cv.damaged(df), df).collect() == []
    rng = random.Random(9)
    big = [(1, k, rng.choice(["user", "assistant"]), f"{k}.") for k in range(3000)]
    df = spark.createDataFrame(big, ROWS)
    [r] = cv.repair(df, df).collect()
    codes = bytes(0 + (1 if x[2] == "user" else 2) for x in big)
    at = cv.END
    for code in reversed(codes):
        at = cv.before(code, at)
    assert r.cost == at[0] and set(r.audit) <= set("DIKR") and len(r.audit) >= 3000


@pytest.mark.parametrize("seed", range(4))
def test_walker_checkpoints_equal_full_vectors(seed):
    rng = random.Random(seed)
    codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(rng.randint(1, 400)))
    walker = cv.Walker()
    got, state, cost = walker.forward(codes, walker.of(cv.END), 0)
    vectors = [cv.END]
    for code in reversed(codes):
        vectors.append(cv.before(code, vectors[-1]))
    vectors.reverse()
    s, want = 0, []
    for k, code in enumerate(codes):
        done, s = cv.edits(code, vectors[k], vectors[k + 1], s)
        want.append(done)
    assert got == want and state == s and cost + 2 * len(cv.ending(state)) == vectors[0][0]
    m = cv.matrix(codes)
    assert all(min(m[x][t] + cv.END[t] for t in range(4)) == vectors[0][x] for x in range(4))
    size, stored = walker.checkpoints(codes, walker.of(cv.END))
    assert len(stored) <= size + 3


def test_repaired_rows_are_the_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "More"), (1, 2, "user", "End?")]
    df = spark.createDataFrame(rows, ROWS)
    found = cv.facts(df)
    out = cv.repaired(df, found.select("c", "audit")).where("position > 0").orderBy("position").collect()
    assert "".join(r.role[0] for r in out) == "ua" * (len(out) // 2)
