"""Turns, churn, activity and change jobs against brute force."""

import random

from pyspark.sql import functions as F

from tracelake.operators import activity as A
from tracelake.operators import changes as C
from tracelake.operators import churn as H
from tracelake.operators.state import open_turns


def test_open_turns_fold(spark):
    rnd = random.Random(7)
    rows = []
    for f in range(6):
        for o in range(60):
            started = rnd.random() < 0.55
            rows.append((f"f{f}", o, started, None if rnd.random() < 0.05 else f"t{rnd.randrange(6)}", None if started else rnd.choice(["complete", "aborted"])))
    want = {}
    for f, o, started, turn, outcome in rows:
        open_, ended, emptied = want.get(f, (set(), None, None))
        if started:
            open_.add(turn or f"o{o}")
        else:
            if turn in open_:
                open_.remove(turn)
            else:
                open_.clear()
            ended, emptied = outcome, emptied if open_ else o
        want[f] = (open_, ended, emptied)
    df = spark.createDataFrame(rows, "file string, ord bigint, started boolean, turn_id string, outcome string")
    got = {r.file: (r.open_turns, r.last_turn_end, r.emptied_at) for r in open_turns(df).collect()}
    assert got == {f: (len(a), b, c) for f, (a, b, c) in want.items()}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_line_delta(spark):
    rnd = random.Random(2)
    texts = [["".join(rnd.choice("abc") for _ in range(1)) for _ in range(rnd.randrange(0, 12))] for _ in range(60)]
    pairs = [(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    df = spark.createDataFrame(pairs, "i int, old_string string, new_string string")
    got = {r.i: (r.added, r.removed) for r in H.with_line_delta(df).collect()}
    for i, old, new in pairs:
        a, b = (old.split("\n") if old else []), (new.split("\n") if new else [])
        k = lcs(a, b)
        assert got[i] == (len(b) - k, len(a) - k)
    old = [f"l{i}" for i in range(600)]
    assert H._line_delta("\n".join(old), "\n".join(x if i % 2 else "new " + x for i, x in enumerate(old))) == (300, 300)


def test_patches(spark):
    p = "*** Begin Patch\n+no\n*** Update File: a/x.py\n*** Move to: a/y.py\n@@ f\n-1\n+2\n+3\n 4\n*** Delete File: z\n*** End Patch"
    df = spark.createDataFrame([("s", p)], "s string, patch string")
    (files,) = [r[0] for r in df.select(H.patch_files("patch")).collect()]
    assert [tuple(f) for f in files] == [("update", "a/x.py", "a/y.py", 2, 1), ("delete", "z", None, 0, 0)]


def test_activity(spark):
    now = 10_000_000
    end = now // 60_000
    ev = spark.createDataFrame([("a", now), ("a", now - 60_000), ("a", now - 29 * 60_000), ("a", now - 31 * 60_000), ("b", 5)], "k string, ts_ms bigint")
    got = {r.k: r for r in A.activity_buckets(ev, ["k"], now=now).collect()}
    assert got["a"].end == end * 60_000 and got["a"].counts[-1] == 1 and got["a"].counts[0] == 1 and sum(got["a"].counts) == 3
    assert got["b"].counts == [0] * 30
    ticks = spark.createDataFrame([("a", 1000, t) for t in (900, 1499, 1500, 2500, 9000, 9100)], "k string, started_at bigint, ts_ms bigint")
    assert A.tick_offsets(ticks, ["k"]).first().ticks == [0, 1, 2, 8]
    many = spark.range(10_000).select(F.lit("a").alias("k"), F.lit(0).alias("started_at"), (F.col("id") * 1000).alias("ts_ms"))
    assert A.tick_offsets(many, ["k"]).first().ticks == list(range(10_000))
    out = A.tick_offsets(many, ["k"], max_ticks=4000).first().ticks
    assert out == [int(i * 2.5) for i in range(4000)]
    spans = spark.createDataFrame([(0, 120_000), (60_000, 60_000), (400_000, 400_001)], "started_at bigint, ended_at bigint")
    got = {r.bucket_start // 60_000: r.alive for r in A.concurrency(spans).collect()}
    assert got == {0: 1, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}


def test_digests_do_not_depend_on_order(spark):
    rows = [("g", i, "x") for i in range(20)]
    a = C.facts_hash(spark.createDataFrame(rows, "g string, i int, s string"), ["g"], ["i", "s"]).first().facts_hash
    b = C.facts_hash(spark.createDataFrame(rows[::-1], "g string, i int, s string").repartition(7), ["g"], ["i", "s"]).first().facts_hash
    c = C.facts_hash(spark.createDataFrame(rows[1:], "g string, i int, s string"), ["g"], ["i", "s"]).first().facts_hash
    assert a == b != c
