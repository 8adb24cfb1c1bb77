"""Forests, cycles, chains and ordered scans against brute force."""

import random

from pyspark.sql import functions as F

from tracelake.operators import segments as G
from tracelake.operators import tree as T


def test_tree_random_forest(spark):
    rnd = random.Random(3)
    parent = {i: (rnd.randrange(i) if i and rnd.random() > 0.1 else None) for i in range(300)}
    parent[300], parent[301] = 9999, 301  # dangling, self
    df = spark.createDataFrame(list(parent.items()), "id int, parent int")
    got = {r.id: r.path for r in T.resolve_tree(df).collect()}

    def path(i):
        p = parent[i]
        return [i] if p is None or p == 9999 or p == i else [*path(p), i]

    assert got == {i: path(i) for i in parent}


def test_deep_chain_beyond_the_usual_depth(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "id int, parent int")
    got = {r.id: (r.root, r.depth) for r in T.resolve_tree(df, max_depth=16).collect()}
    assert got == {i: (0, i) for i in range(200)}


def test_cycles_are_cut_at_the_smallest_id(spark):
    # 1->2->3->1, 4->1, 5->5, 6->7->6, 8->4
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7), (7, 6), (8, 4), (9, None)], "id int, parent int")
    cut = {r.id: r.parent for r in T.cut_cycles(df).collect()}
    assert cut == {1: None, 2: 3, 3: 1, 4: 1, 5: None, 6: None, 7: 6, 8: 4, 9: None}
    tree = {r.id: r.path for r in T.resolve_tree(df, max_depth=2).collect()}
    assert tree[2] == [1, 3, 2] and tree[8] == [1, 4, 8] and tree[7] == [6, 7]
    named = df.select(F.col("id").cast("string"), F.col("parent").cast("string"))
    assert {r.id: r.parent for r in T.cut_cycles(named, mode="main").collect()}["1"] == "main"


def test_rollup_keep_and_collapse(spark):
    rows = [("r", None, "done", 1), ("a", "r", "done", 2), ("b", "a", "running", 3), ("c", "r", "done", 4), ("d", "c", "failed", 5)]
    tree = T.resolve_tree(spark.createDataFrame(rows, "id string, parent string, state string, n int")).cache()
    sums = {r.ancestor: r.n for r in T.subtree_rollup(tree, [F.sum("n").alias("n")]).collect()}
    assert sums == {"r": 15, "a": 5, "b": 3, "c": 9, "d": 5}
    assert {r.id for r in T.keep_ancestors(tree, F.col("state") == "failed").collect()} == {"r", "c", "d"}
    shown = T.collapse_finished(tree, F.col("state").isin("done", "failed"))
    assert {r.id for r in shown.collect()} == {"r", "a", "b"}
    more = T.add_missing_ancestors(tree.where("id = 'b'"), tree)
    assert {r.id for r in more.collect()} == {"r", "a", "b"}


def test_chain(spark):
    chain = [(f"e{i}", f"e{i - 1}" if i else None) for i in range(150)] + [("x", "missing"), ("y", "e5")]
    entries = spark.createDataFrame(chain, "id string, previous_id string")
    heads = spark.createDataFrame([("e149",), ("y",), ("nope",), ("x",)], "head string")
    got = {}
    for r in T.walk_chain(entries, heads).collect():
        got.setdefault(r.head, {})[r.hops] = r.id
    assert got["e149"] == {h: f"e{149 - h}" for h in range(150)}
    assert got["y"] == {0: "y", **{h + 1: f"e{5 - h}" for h in range(6)}}
    assert got["x"] == {0: "x"} and "nope" not in got
    short = T.walk_chain(entries, heads.where("head = 'e149'"), max_hops=10)
    assert short.count() == 11


def test_chain_with_a_cycle_gives_each_entry_once(spark):
    entries = spark.createDataFrame([("h", "c"), ("c", "b"), ("b", "a"), ("a", "c"), ("s", "s")], "id string, previous_id string")
    heads = spark.createDataFrame([("h",), ("b",), ("s",)], "head string")
    got = {(r.head, r.hops): r.id for r in T.walk_chain(entries, heads).collect()}
    assert got == {("h", 0): "h", ("h", 1): "c", ("h", 2): "b", ("h", 3): "a", ("b", 0): "b", ("b", 1): "a", ("s", 0): "s"}


def test_all_missing_ancestors(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(12)] + [("x", "y"), ("y", "x")]
    nodes = spark.createDataFrame(rows, "id string, parent string")
    got = T.add_missing_ancestors(nodes.where("id in ('n11', 'x')"), nodes)
    assert {r.id for r in got.collect()} == {f"n{i}" for i in range(12)} | {"x", "y"}


def test_segmented_scans(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), i, rnd.choice([None, "x", "y", "z"]), rnd.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ord bigint, v string, n bigint")
    carried = {r.ord: r.c for r in G.carry_last(df, ["k"], "ord", F.col("v"), "c", span=16).collect()}
    before = {r.ord: r.c for r in G.carry_last(df, ["k"], "ord", F.col("v"), "c", span=16, inclusive=False).collect()}
    totals = {r.ord: r.t for r in G.running_total(df, ["k"], "ord", F.col("n"), "t", span=16).collect()}
    place = {r.ord: r.position for r in G.position(df, ["k"], "ord", span=16).collect()}
    prev = {r.ord: r.p for r in G.previous_row(df, ["k"], "ord", ["ord"], "p", span=16).collect()}
    last, run, count, prior = {}, {}, {}, {}
    for k, o, v, n in rows:
        assert before[o] == last.get(k)
        if v is not None:
            last[k] = v
        run[k], count[k] = run.get(k, 0) + n, count.get(k, 0) + 1
        assert (carried[o], totals[o], place[o]) == (last.get(k), run[k], count[k])
        assert (prev[o].ord if prev[o] else None) == prior.get(k)
        prior[k] = o
