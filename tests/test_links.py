"""Links taken in order, components, similar sets and collapsed rows against plain versions."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tracelake.operators import topics as TP, tree as T
from tracelake.operators.components import components
from tracelake.session import cut_lineage


def taken_in_order(links):
    parent = {}

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    for c, t, o in sorted(links, key=lambda x: x[2]):
        if c not in parent and root(t) != c:
            parent[c] = t
    return parent


def test_links_are_taken_in_order(spark):
    two = [("a", "b", 1), ("b", "a", 2)]
    assert {r.child: r.target for r in T.accept_links(spark.createDataFrame(two, "child string, target string, order long")).collect()} == {"a": "b"}
    rng = random.Random(4)
    rows = []
    for world in range(12):
        n = rng.randint(2, 8)
        for _ in range(rng.randint(1, 3 * n)):
            c, t = rng.sample(range(n), 2)
            rows.append((f"{world}-{c}", f"{world}-{t}", len(rows)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(c, t, o) for (c, t, _), o in zip(rows, order, strict=True)]
    got = T.accept_links(spark.createDataFrame(rows, "child string, target string, order long")).collect()
    assert {r.child: r.target for r in got} == taken_in_order(rows)
    assert T.accept_links(spark.createDataFrame([], "child string, target string, order long")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    of = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for a, b in links * 70:
        if a != b:
            of[a] = of[b] = min(of[a], of[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == of
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_and_groups(spark):
    rng = random.Random(5)
    sets = []
    for k in range(150):
        base = rng.sample("abcdefghijkl", rng.randint(1, 7))
        sets.append((k, rng.choice(["p", "q"]), sorted(base)))
    df = spark.createDataFrame(sets, "id long, scope string, tokens array<string>")
    want, links = {}, {k: 0 for k, *_ in sets}
    for a, s, x in sets:
        for b, t, y in sets:
            j = len({*x} & {*y}) / len({*x} | {*y})
            if a < b and s == t and j >= 0.6:
                want[a, b] = j
                links[a] += 1
                links[b] += 1
    got = {(r.id_a, r.id_b): r.jaccard for r in TP.similar_pairs(df, scope=["scope"]).collect()}
    assert got == want
    groups = {r.id: (r.links, r.group) for r in TP.jaccard_groups(df, scope=["scope"]).collect()}
    assert {k: v[0] for k, v in groups.items()} == links
    assert all(groups[a][1] == groups[b][1] for a, b in want) and all(g <= k for k, (_, g) in groups.items())


def test_the_index_holds_numbers_of_sets_that_meet(spark):
    # every set has two of 60 very frequent words, which alone make no pair
    rng = random.Random(6)
    sets = [(k, sorted([*rng.sample([f"w{i}" for i in range(60)], 2), f"x{k % 100}", f"y{k % 101}"])) for k in range(2000)]
    keys = TP.similarity_keys(spark.createDataFrame(sets, "id long, tokens array<string>"), "id", "tokens", [], 0.6)
    assert {f.name: f.dataType.typeName() for f in keys.schema} == {"key": "long", "id": "long", "n": "integer", "m": "integer"}
    a, b = keys.alias("a"), keys.alias("b")
    met = {(r.x, r.y) for r in a.join(b, TP._can_match(0.6) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    similar = {(x, y) for x, s in sets for y, t in sets[x + 1 :] if len({*s} & {*t}) >= 3}
    assert similar <= met and len(met) < 60_000
    apart = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d"])], "id long, tokens array<string>")
    assert TP.similarity_keys(apart, "id", "tokens", [], 0.6).count() == 0


def test_collapsed_rows_fill_the_room(spark):
    rows = [("m", None, "running", 0), ("a", "m", "done", 5), ("b", "a", "done", 9), ("c", "m", "done", 7), ("d", "m", "running", 1), ("e", "d", "done", None)]
    tree = T.resolve_tree(spark.createDataFrame([(*r, 1) for r in rows], "id string, parent string, state string, ended_at long, s int"), by=["s"])
    for room, shown, hidden in [(0, "md", 4), (1, "md", 4), (2, "mdab", 3), (3, "mdabc", 2), (4, "mdabce", 0), (9, "mdabce", 0)]:
        got = T.pick_collapsed(tree, F.col("state") == "done", room, by=["s"]).collect()
        assert {r.id for r in got} == set(shown) and {r.hidden for r in got} == {hidden}, room


def sharing_little(seed, n=300):
    """Sets of twelve tokens; a token each ten sets share is the rarest, the others come from forty."""
    rng = random.Random(seed)
    words = ["".join(w) for w in itertools.product("bdgkz", "aeiou", "bdgkz", "aei", "bd")]
    rng.shuffle(words)
    sets = [[words[100 + k % 30], *rng.sample(words[:40], 11)] for k in range(n)]
    return sets + [[*s[:11], words[99]] for s in sets[:20]]  # and some that are similar


def similar_of(sets, threshold=0.6):
    return {(a, b) for b in range(len(sets)) for a in range(b) if len({*sets[a]} & {*sets[b]}) >= threshold * len({*sets[a]} | {*sets[b]}) - 1e-9}


def watched(monkeypatch):
    """Numbers of candidate pairs whose tokens are fetched."""
    seen, verified = [], TP._verified
    monkeypatch.setattr(TP, "_verified", lambda pairs, *a: seen.append(pairs.distinct().count()) or verified(pairs, *a))
    return seen


@pytest.mark.parametrize("rare", [1000, 0])
def test_candidates_are_ruled_out_before_they_are_written(spark, monkeypatch, rare):
    """A rarest token in common makes no pair; with every token frequent, pairs of tokens are the keys and nothing is lost."""
    monkeypatch.setattr(TP, "RARE", rare)
    sets = sharing_little(1)
    seen = watched(monkeypatch)
    got = TP.jaccard_pairs(spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "id long, tokens array<string>")).collect()
    want = similar_of(sets)
    assert len(want) >= 20 and {r.id_b for r in got} == {b for _, b in want} and {(r.id_a, r.id_b) for r in got} <= want
    assert len(want) <= seen[0] < 500


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_frequent_tokens_lose_no_link(spark, monkeypatch, threshold):
    monkeypatch.setattr(TP, "RARE", 2)
    rng = random.Random(8)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randint(1, 7))) for _ in range(120)]
    got = {(r.id_a, r.id_b) for r in TP.similar_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>"), threshold=threshold).collect()}
    assert got == similar_of(sets, threshold)


def test_index_rows_of_a_set_depend_on_its_own_size(spark, monkeypatch):
    """Ten tokens, all of them frequent, make no more rows than pairs of tokens in a prefix, whatever sizes partners have."""
    monkeypatch.setattr(TP, "RARE", 0)
    rng = random.Random(9)
    sets = [(k, sorted(rng.sample("abcdefghijklmnopqr", 10))) for k in range(400)]
    keys = TP.similarity_keys(spark.createDataFrame(sets, "id long, tokens array<string>"), "id", "tokens", [], 0.6)
    assert keys.groupBy("id").count().agg(F.max("count")).first()[0] <= 15


def test_shuffle_files_go_with_the_lineage(spark):
    """What a step shuffled is deleted once its result is written, and the setting is as before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = disk.getAllFiles().size(), spark.conf.get(key)
    out = cut_lineage(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    assert sorted(r["count"] for r in out.collect()) == [500] * 10 and spark.conf.get(key) == setting
    for _ in range(50):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= before


@pytest.mark.parametrize("rare", [1000, 0])
def test_title_merge_fetches_few_candidates(spark, monkeypatch, rare):
    """The greedy rule, while hardly any pair but the similar ones is written in a round."""
    monkeypatch.setattr(TP, "RARE", rare)
    sets = sharing_little(2)
    seen = watched(monkeypatch)
    got = TP.merge_titles(spark.createDataFrame([("p", k, " ".join(s)) for k, s in enumerate(sets)], "project string, n long, title string"), order=["n"]).collect()
    near, leaders, want = similar_of(sets), [], {}
    for b in range(len(sets)):
        lead = next((a for a in leaders if (a, b) in near), b)
        leaders += [b] if lead == b else []
        want[b] = " ".join(sorted(sets[lead]))
    assert {r.n: r.leader for r in got} == want and len(leaders) < len(sets)
    assert max(seen) < 500
