import random

import pytest

import corpus_pipeline
from tests.llm.helpers import DOCS, prose
from tracelake.llm import shingle_join, simhash


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    passage = prose(rng, 40)
    texts = [prose(rng, rng.randint(30, 150)) for _ in range(12)]
    texts += [edited(rng, t, rng.randint(1, 6)) for t in texts for _ in range(5)]
    base = prose(rng, 200)
    texts += [edited(rng, base, rng.randint(0, 6)) for _ in range(40)]  # a dense group
    texts += [passage + " " + prose(rng, rng.randint(3, 12)) for _ in range(40)]  # one common passage
    texts += ["a b c", "A  b c", "a b", None, "", " \n"]
    rng.shuffle(texts)
    return texts


def classes(texts):
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in ((t or "").lower().split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("seed,hubs,small,sample", [(1, 4, 32, 8000), (2, 1, 2, 8000), (3, 1, 2, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, hubs, small, sample):
    """Small numbers of hubs force the second comparison; a sample of almost nothing gives another order."""
    texts = corpus(seed)
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    got = {r.node: r.root for r in simhash.components(shingle_join.links(rows, sample=sample, hubs=hubs, small=small)).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == classes(texts)


def test_the_stage_takes_out_copies_beyond_four_bits(spark):
    """Of each group the smallest id stays; op8's defaults leave most of these."""
    rng = random.Random(5)
    texts = [prose(rng, 200) for _ in range(8)]
    texts += [edited(rng, t, 4) for t in texts]
    far = [(simhash.fingerprint_of(texts[k]) ^ simhash.fingerprint_of(texts[k + 8])).bit_count() > simhash.BUDGET for k in range(8)]
    assert sum(far) >= 4
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [k for k, c in enumerate(classes(texts)) if c == k]


def test_the_tries_find_links_first(spark, monkeypatch):
    """Groups within four bits are connected by the tries and checked exactly; the join only gets what is left."""
    rng = random.Random(6)
    texts = [prose(rng, 400) for _ in range(6)]
    texts += [t + " " + prose(rng, 1) for t in texts for _ in range(2)] + [texts[0].upper(), None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    prints = [simhash.fingerprint_of(t, shingle_join.SHINGLE) for t in texts]
    within = {b for b in range(len(texts)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= simhash.BUDGET}
    found = {(r.a, r.b) for r in shingle_join.trie_checked(rows).collect()}
    assert len(within) >= 8 and {b for _, b in found} == within
    sets = [set(shingle_join.shingles(t)) for t in texts]
    assert all(shingle_join.similar(sets[a], sets[b]) for a, b in found)
    called = []
    trie = simhash.trie_links
    monkeypatch.setattr(shingle_join, "trie_links", lambda *a: called.append(a) or trie(*a))
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert called and kept == [k for k, c in enumerate(classes(texts)) if c == k]


def test_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (9, "z"), (None, "y")], "doc_id long, text string")
    got = shingle_join.near_groups(docs).collect()
    assert sorted((r.component_id is None, r.component_id, r.kept) for r in got) == [(False, 3, False), (False, 3, False), (False, 3, True), (False, 9, True), (True, None, True)]
    assert shingle_join.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 30, 400, 5000])
def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(length):
    rng = random.Random(length)
    base = prose(rng, length)
    for edits in (0, 1, min(9, length), length // 2):
        a, b = base, edited(rng, base, edits)
        differ = len(set(shingle_join.shingles(a)) ^ set(shingle_join.shingles(b)))
        words = shingle_join.sketch(a) ^ shingle_join.sketch(b)
        assert sum(int(w).bit_count() for w in words.view("u8")) <= differ
    assert not (shingle_join.sketch(None) ^ shingle_join.sketch("  \n")).any()


@pytest.mark.parametrize("earlier", [1, 64])
def test_a_pair_is_made_in_one_of_its_large_lists(spark, monkeypatch, earlier):
    """Texts that share most shingles meet in many lists; all pairs of the second comparison together are no more rows than pairs."""
    rng = random.Random(11)
    base = prose(rng, 200)
    texts = [edited(rng, base, 9) for _ in range(70)] + [edited(rng, base, 1) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    made, met = [], shingle_join._met
    monkeypatch.setattr(shingle_join, "_met", lambda *a: made.append(met(*a)) or made[-1])
    got = {r.node: r.root for r in simhash.components(shingle_join.links(rows, hubs=1, small=2, sample=8000, earlier=earlier)).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == classes(texts)
    rows_made, pairs = made[1].count(), made[1].select("a", "b").distinct().count()
    assert pairs > 100 and (rows_made == pairs if earlier == 64 else rows_made > pairs)
