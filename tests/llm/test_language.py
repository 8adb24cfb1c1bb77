import random
import zlib

import numpy as np

from tests.llm.helpers import DOCS, EXTRA, prose, with_extra
from tracelake.llm import language
from pyspark.sql import functions as F


def rows(n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = "en" if k % 2 else "fr"
        out.append((k, prose(rng, rng.randint(1, 60), kind), kind, "s", 0))
    return out + [(500, None, "en", "s", 0), (501, "", "fr", "s", 0), (502, "123 !? 45", "en", "s", 0), (None, prose(rng, 2000, "en"), None, None, None), out[3], out[3]]


def test_held_out_accuracy_and_edges(spark):
    data = rows()
    df = spark.createDataFrame(with_extra(data), DOCS + EXTRA)
    away = language.held_out(F.col("doc_id"))
    net = language.train(df, ~away)
    assert net.languages == ["en", "fr"]
    got = df.select("doc_id", "text", "lang", away.alias("out"), language.predicted(F.col("text"), net).alias("p")).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        assert 0 <= r.p.score <= 1
        if not any(map(str.isalpha, r.text or "")):
            assert (r.p.lang, r.p.score) == ("und", 0.0)
    test = [r for r in got if r.out and r.text and any(map(str.isalpha, r.text))]
    assert sum(r.p.lang == r.lang for r in test) / len(test) > 0.9
    assert [r.p.lang for r in got if r.doc_id is None] == ["en"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 3)], DOCS)
    net = language.train(df, F.lit(True))
    assert net is None
    assert df.select(language.predicted(F.col("text"), net).alias("p")).first().p.asDict() == {"lang": "und", "score": 0.0}
    assert language.train(df.limit(0), F.lit(True)) is None


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    h, steps, batch = 3, 5, 4
    d = language.Direction(rng.standard_normal((3 * h, 256)), rng.standard_normal((3 * h, h)))
    x = rng.integers(0, 6, (steps, batch)).astype(np.uint8)
    weight = rng.standard_normal((steps, h, batch))

    def loss(d):
        return float((language._read(d, x) * weight).sum())

    trace: list = []
    language._read(d, x, trace)
    table, back = language._learn(d, x, trace, weight)
    for array, grad in ((d.table, table), (d.back, back)):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in array[:, :6].shape)
            old = array[at]
            array[at] = old + 1e-6
            up = loss(d)
            array[at] = old - 1e-6
            down = loss(d)
            array[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


def test_segments_of_any_batch_give_the_same(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 200)).encode() for _ in range(9)]
    net = language.fit([t for t in texts if t], ["a", "b"] * 4 + ["a"] * (len([t for t in texts if t]) - 8), rounds=3)
    one = language.pooled(net, texts)
    monkeypatch.setattr(language, "SIDE_BY_SIDE", 2)
    two = language.pooled(net, texts)
    assert np.allclose(one, two, atol=1e-5)
    assert np.allclose(one.sum(axis=1), [1.0 if t else 0.0 for t in texts], atol=1e-4)


def test_every_label_is_learned(spark):
    """More labels than any fixed number of frequent ones: a rare one is among what can be predicted."""
    rows = [(100 * k + j, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} " * 20, f"l{k:02d}") for k in range(70) for j in range(3 if k else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(docs, F.lit(True), rows_per_language=3, rounds=2)
    assert len(net.languages) == 70
