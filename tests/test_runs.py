"""Concurrency as runs against a plain count."""

import random

from tracelake.operators import activity as A

ROWS = "k string, started_at long, ended_at long"


def plain(rows, size):
    buckets = [(s // size, max(s, e - 1) // size) for s, e in rows if s is not None]
    cuts = sorted({b for a, z in buckets for b in (a, z + 1)})
    return [(a * size, b * size, sum(x <= a <= y for x, y in buckets)) for a, b in zip(cuts, cuts[1:], strict=False)]


def test_runs_equal_plain_count(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), s := rng.randrange(0, 500_000), s + rng.randrange(0, 90_000)) for _ in range(150)]
    rows += [("a", 10**15, 10**15 + 5), ("b", None, 7), ("a", 60_000, 60_000), ("b", 120_000, 60_000)]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, A.concurrency_runs(df).collect()))
        assert got == plain([r[1:] for r in rows], 60_000)  # a wild time adds a run, not a billion rows
        plan = A.concurrency_runs(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [lead" in plan or "windowspecdefinition(__part" in plan
        for k in "ab":
            own = sorted(tuple(r)[1:] for r in A.concurrency_runs(df, ["k"]).where(f"k = '{k}'").collect())
            assert own == plain([r[1:] for r in rows if r[0] == k], 60_000)
        dense = A.concurrency(df.where("started_at < 1000000")).count()
        want = plain([r[1:] for r in rows if r[1] is not None and r[1] < 10**6], 60_000)
        assert dense == (want[-1][1] - want[0][0]) // 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert A.concurrency_runs(df.limit(0)).count() == 0
