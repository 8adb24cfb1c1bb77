import pathlib
import random
import urllib.parse

import numpy as np
import pytest

from tests.llm.helpers import DOCS, EXTRA, documents, with_extra
from tracelake.llm import simhash


def roots(values, budget):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def cloud(rng, centres, each, bits):
    out = {0, (1 << 64) - 1}
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            out.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))))
    return sorted(out)


@pytest.mark.parametrize("budget,task_rows", [(4, 200_000), (4, 24), (2, 16)])
def test_links_equal_brute_force(spark, budget, task_rows):
    """Small tasks force the cut of nodes into pairs of child nodes."""
    values = cloud(random.Random(budget * 100 + task_rows), 12, 20, 5)
    want = roots(values, budget)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.trie_links(prints, budget, task_rows)).collect()}
    groups, mine = {}, {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
        mine.setdefault(found.get(signed(v), signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_a_dense_group_gives_a_forest():
    rng = random.Random(5)
    values = np.unique(np.array([v for v in cloud(rng, 1, 3000, 2)], np.uint64))
    start = np.array([[0, len(values), 0, len(values), 0]])
    label = simhash.trie_join(values, None, start, 0, 4)
    want = roots(values[:400].tolist(), 4)
    assert len(np.unique(label)) >= 1 and len(set(want.values())) >= 1
    centre = [k for k, v in enumerate(values) if v not in (0, (1 << 64) - 1)]
    assert len(np.unique(label[centre])) == 1


def test_fingerprints_and_groups(spark):
    rows = documents(4, 25)
    df = spark.createDataFrame(with_extra(rows), DOCS + EXTRA)
    carry = [c for c in df.columns if c not in ("kept",)]
    got = simhash.near_groups(df, carry=carry).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        assert int(r.fingerprint, 16) == simhash.fingerprint_of(r.text)
        prints.setdefault(int(r.fingerprint, 16), []).append(r.doc_id)
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of("") == simhash.fingerprint_of(" \n") == 0
    want = roots(sorted(prints), 4)
    low = {}
    for v, ids in prints.items():
        low.setdefault(want[v], []).extend(i for i in ids if i is not None)
    for r in got:
        ids = low[want[int(r.fingerprint, 16)]]
        assert r.component_id == (min(ids) if ids else None)
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_majority_is_strict_and_short_texts_are_one_shingle():
    import xxhash

    assert simhash.fingerprint_of("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d", b"b c d e")]
    assert simhash.fingerprint_of("a b  c\td e") == h[0] & h[1]


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("options", [{}, {"task_links": 60}, {"task_links": 1}])
def test_few_links_travel_in_few_tasks(spark, monkeypatch, options):
    """A round takes as many tasks as its links need, not as many as a shuffle has parts, and leaves no table of an earlier round."""
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 120) if k % 9] + [(500, k) for k in range(501, 640)] + [tuple(rng.sample(range(900, 1300), 2)) for _ in range(150)] + [(7, 7)]
    low = {v: v for p in pairs for v in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    made, names, stash = [], [], simhash.stash

    def kept(df, name, *a, **b):
        out = stash(df, name, *a, **b)
        made.append(df.rdd.getNumPartitions())
        names.extend(out.inputFiles()[:1])
        return out

    monkeypatch.setattr(simhash, "stash", kept)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = simhash.components(spark.createDataFrame(pairs, "a long, b long"), **options)
        found = {r.node: r.root for r in got.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {v: found.get(v, v) for v in low} == low
    most = min(24, -(-len(pairs) // options.get("task_links", simhash.TASK_LINKS)))
    assert len(made) > 2 and max(made[1:]) <= most
    folders = [pathlib.Path(urllib.parse.urlparse(f).path).parent for f in names]
    assert [f.exists() for f in folders] == [False] * (len(folders) - 1) + [True]
