import random
from collections import Counter

import numpy as np

from tests.llm.helpers import DOCS, EXTRA, documents, with_extra
from tracelake.llm import line_dedup, secrets
from pyspark.sql import functions as F


def lined(seed=1, n=30):
    rng = random.Random(seed)
    rows = [(k, "\n".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randint(0, 14))), "en", "s", 0) for k in range(n)]
    return rows + [(100, None, "en", None, None), (101, "", None, "s", 0), (102, "\n" * 9, "en", "s", 0), (103, "aaa\r\nbbb\r\nccc", "en", "s", 0)]


def brute(rows, window):
    seen, cut = set(), {}
    for r in sorted(rows):
        lines = (r[1] or "").split("\n")
        for k in range(len(lines) - window + 1):
            w = tuple(lines[k : k + window])
            if w in seen:
                cut.setdefault(r[0], set()).update(range(k, k + window))
            seen.add(w)
    out = []
    for r in rows:
        lines, gone = (r[1] or "").split("\n"), cut.get(r[0], set())
        out.append((r[0], len(lines), len(gone), sum(k in gone and k - 1 not in gone for k in gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out)


def test_lines_equal_brute_force(spark):
    for window in (1, 3):
        rows = lined(window)
        df = spark.createDataFrame(with_extra(rows), DOCS + EXTRA)
        got = line_dedup.without_repeated_lines(df, window=window).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_removed, r.n_spans, r.kept_text) for r in got) == brute(rows, window)


def test_repeated_rows_and_null_ids(spark):
    t = "p\nq\nr\ns"
    rows = [(1, t, "en", "s", 7), (1, t, "en", "s", 7), (None, t, "en", "s", 7)]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.kept_text) for r in got) == {(1, t): 1, (1, ""): 1, (None, ""): 1}
    assert line_dedup.without_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def planted(n=200, seed=4):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows, truth = [], {}
    for k in range(n):
        kind = k % 5
        value = [f'token = "{hexes(40)}"', f"password={hexes(18)}", "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNP234567", k=16)), "".join(rng.choices("0123456789", k=16)), f"ab.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com"][kind]
        rows.append((k, f"ther is an {value} ing the", "en", "src", 0))
        truth[k] = kind < 3
    return rows, truth


def test_secrets_are_told_from_other_findings(spark):
    rows, truth = planted()
    df = spark.createDataFrame(with_extra(rows), DOCS + EXTRA)
    learn = df.where("doc_id < 120")
    back = secrets.background(df)
    forest = secrets.train(learn, back)
    got = secrets.scanned(df, back, forest, as_="__f").where("doc_id >= 120").collect()
    for r in got:
        assert len(r["__f"]) == 1
        assert (r["__f"][0].score >= secrets.THRESHOLD) == truth[r.doc_id], r.text


def test_labelled_findings_are_a_parameter(spark):
    rows, _ = planted(60)
    df = spark.createDataFrame(rows, DOCS)
    back = secrets.background(df)
    labelled = secrets.scanned(df, back, []).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.start", (F.length("f.value") == 40).cast("int").alias("secret"))
    forest = secrets.train(df, back, labelled=labelled)
    got = secrets.scanned(df, back, forest).collect()
    assert all((f.score >= 0.5) == (len(f.value) == 40) for r in got for f in r.findings)


def test_forest_is_a_vote_of_trees():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, secrets.FEATURES))
    y = (x[:, 3] + (x[:, 7] > 0) > 0.5).astype(float)
    forest = secrets.grow(x, y)
    assert ((secrets.vote(forest, x) > 0.5) == y).mean() > 0.9
    assert secrets.grow(x, np.ones(400)) == [] and secrets.vote([], x[:2]).tolist() == [1.0, 1.0]


def test_secret_edges(spark):
    rows = documents(2, 3)
    df = spark.createDataFrame(rows, DOCS)
    back = secrets.background(df)
    assert secrets.train(df, back) == []
    assert len(secrets.scanned(df, back, []).collect()) == len(rows)
    # without a forest the form decides; not everything is a secret
    some = spark.createDataFrame([(1, 'password = "Tr0ub4dor" and Ab3dEf9hIj2 alone', "en", "s", 1)], DOCS)
    [r] = secrets.scanned(some, back, []).collect()
    assert [(f.value, f.score) for f in r.findings] == [("Tr0ub4dor", 1.0), ("Ab3dEf9hIj2", 0.0)]
    empty = spark.createDataFrame([], DOCS)
    assert secrets.scanned(empty, secrets.background(empty), []).count() == 0


def test_every_assigned_value_is_a_candidate():
    values = {
        'password = "Tr0ub4dor"': "Tr0ub4dor", "pwd: hunter2x9": "hunter2x9", "secret: 'aB3dE6gH'": "aB3dE6gH", 'password = "correct-horse-battery"': "correct-horse-battery",
        "password=a!b$c#d%e&f*": "a!b$c#d%e&f*", "db_token=x": "x", '{"api_key": "p q", "n": 1}': "p q", "secret: token=abc.": "abc", 'pwd="open ended': "open",
    }
    for text, value in values.items():
        found = secrets.candidates(f"so {text}\nand more")
        assert [f[2] for f in found] == [value], text
        assert secrets.label_by_form(found[0]) == 1
    assert [f[2] for f in secrets.candidates("token=one&secret=two3 Ab3dEf9h, plainword")] == ["one&", "two3", "Ab3dEf9h"]
    assert not secrets.candidates('password = "" ') and not secrets.candidates("token: ") and not secrets.candidates(None)
