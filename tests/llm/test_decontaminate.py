import random
import re

import numpy as np
import pytest

from tests.llm.helpers import DOCS, EXTRA, documents, with_extra
from tracelake.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, width):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        v = words(body)
        for k in range(max(1, len(v) - width + 1) if v else 0):
            win = v[k : k + width]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("seed,blocks", [(1, 200_000), (2, 12), (3, 200_000)])
def test_equals_brute_force(spark, seed, blocks):
    rng = random.Random(seed)
    rows = documents(seed, 40)
    texts = [r[1] for r in rows if r[1]]
    items = [(1, None), (2, ""), (3, "One"), (None, "two, words!"), (4, "no such words here at all in any text of the table")]
    for k in range(12):
        w = words(rng.choice(texts))
        at = rng.randrange(max(1, len(w) - 4))
        items.append((10 + k, "; ".join(w[at : at + rng.randint(3, 9)]).upper()))
    items.append((10, items[-1][1]))
    df = spark.createDataFrame(with_extra(rows), DOCS + EXTRA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(df, bench, width=4, shard_bytes=300, block_windows=blocks, as_="__f").collect()
    assert len(got) == len(rows)
    hits = 0
    for r in got:
        n, h, found = brute(r.text, items, 4)
        f = r["__f"]
        assert (f.n_words, sum(s.words for s in f.spans), list(f.items)) == (n, h, found)
        hits += h > 0
        raw = (r.text or "").encode()
        for s in f.spans:
            assert len(D.words_of(raw[s.start : s.end].decode())) == s.words
    assert hits > 3


def test_removal(spark):
    rows = [(1, "Keep this. Alpha beta, GAMMA delta! And this.", "en", "s", 45), (2, "alpha beta gamma delta", "en", "s", 22), (3, None, "en", "s", None), (4, "...", "en", "s", 3)]
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    got = {r.doc_id: r for r in D.decontaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == "Keep this. ! And this." and got[1].n_chars == len(got[1].text)
    assert got[3].text is None and got[4].n_chars == 3


@pytest.mark.parametrize("seed", range(30))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(5)]
    seq = np.concatenate([np.append(r, 0) for r in runs])
    index = D.FMIndex(seq, sample=int(rng.integers(1, 9)))
    for _ in range(10):
        k = int(rng.integers(1, 5))
        pattern = rng.integers(1, 4, k)
        lo, hi = index.search(pattern[None, :], np.array([k]))
        want = [i for i in range(len(seq) - k + 1) if (seq[i : i + k] == pattern).all()]
        assert hi[0] - lo[0] == len(want)
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, bench).count() == 0
    some = spark.createDataFrame(documents(1, 3), DOCS)
    assert all(not r.found.spans and r.found.n_words == len(words(r.text)) for r in D.contamination(some, bench).collect())
