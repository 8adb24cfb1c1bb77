import math
import random
from collections import defaultdict

from tests.llm.helpers import DOCS, EXTRA, prose, with_extra
from tracelake.llm import quality


def rows(n=300, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        t = prose(rng, rng.randint(20, 80))
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split()) if k % 2 else " ".join(w for w in t.split()[:6] for _ in range(8))
        docs.append((k, t, "en", f"host{k % 3}/p{k % 5}", len(t)))
        if k % 3:
            labels.append((k, int(good)))
        truth[k] = good
    docs += [(900, None, None, None, None), (901, "", "en", "rare", 0), docs[5], docs[5]]
    labels += [(None, 1), (4, None), (6, 0), (6, 1), (7777, 1)]
    return docs, labels


truth: dict = {}


def test_keeps_good_and_rejects_bad(spark):
    docs, labels = rows()
    df = spark.createDataFrame(with_extra(docs), DOCS + EXTRA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.good_documents(df, lab)
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    asked = [k for k in truth if k not in (4, 6)]
    assert sum((k in kept) == truth[k] for k in asked) / len(asked) > 0.97


def test_posteriors_equal_a_plain_computation(spark):
    rng = random.Random(1)
    scored = [(rng.uniform(-4, 4), f"h{rng.randint(0, 4)}" if rng.random() < 0.9 else None, f"p{rng.randint(0, 3)}") for _ in range(200)]
    df = spark.createDataFrame(scored, "evidence double, host string, path string")
    base = 0.6
    found = quality.sites(df, base)
    unit = quality._UNIT
    good = defaultdict(lambda: [0, 0])
    for e, h, p in scored:
        q = round(unit / (1 + math.exp(-(e + math.log(base / (1 - base))))))
        for key in ("all", (h,), (h, p)):
            good[key][0] += 1
            good[key][1] += q
    rate = (good["all"][1] / unit + 1) / (good["all"][0] + 2)
    assert abs(found.rate - rate) < 1e-6

    def strength(groups):
        apart = sum(n * (g / n / unit - prior) ** 2 for n, g, prior in groups)
        chance = sum(prior * (1 - prior) for _, _, prior in groups)
        all_ = sum(n * prior * (1 - prior) for n, _, prior in groups)
        f = max(1e-6, (apart - chance) / max(1e-6, all_ - chance))
        return min(1e6, max(1.0, 1 / f - 1))

    hosts = {k[0]: v for k, v in good.items() if k != "all" and len(k) == 1}
    k1 = strength([(n, g, rate) for n, g in hosts.values()])
    host_rate = {h: (g / unit + k1 * rate) / (n + k1) for h, (n, g) in hosts.items()}
    paths = {k: v for k, v in good.items() if k != "all" and len(k) == 2}
    k2 = strength([(n, g, host_rate[k[0]]) for k, (n, g) in paths.items()])
    for r in quality.decide(df, found).collect():
        n, g = paths[r.host, r.path]
        want = (g / unit + k2 * host_rate[r.host]) / (n + k2)
        assert abs(r.host_rate - host_rate[r.host]) < 1e-3 and abs(r.path_rate - want) < 2e-3
        score = 1 / (1 + math.exp(-(r.evidence + math.log(r.path_rate / (1 - r.path_rate)))))
        assert abs(r.score - score) < 1e-5 and r.kept == (r.score >= 0.5)


def test_without_usable_labels_all_stay(spark):
    docs, _ = rows()
    df = spark.createDataFrame(docs, DOCS)
    for labels in ([], [(1, 1), (2, 1)], [(None, None)]):
        assert quality.good_documents(df, spark.createDataFrame(labels, "doc_id long, quality int")).count() == len(docs)


def test_empty_table(spark):
    docs, labels = rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.good_documents(spark.createDataFrame([], DOCS), lab).count() == 0
    model = quality.fit([d[1] for d in docs[:50]], __import__("numpy").array([float(truth[d[0]]) for d in docs[:50]]))
    empty = quality.graded(spark.createDataFrame([], DOCS), model)
    assert quality.decide(empty, quality.sites(empty, model.rate)).count() == 0
