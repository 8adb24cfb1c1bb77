import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import DOCS, EXTRA, documents, with_extra
from tracelake.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for t, ids in groups.items():
        first = min((i is None, i) for i in ids)[1] if any(i is not None for i in ids) else None
        out += [(i, first, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_equals_brute_force(spark, block):
    rows = documents(2, 30)
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS), block=block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({norm(r[1]) for r in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_equal_hash_and_length_do_not_decide(spark):
    """Blocks of one character: texts of equal length that share blocks and pairs stay apart."""
    texts = ["abab", "abba", "baba", "aabb", "abab", "abbaa", "abba"]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, t string")
    names = {r.uid: (r.level, r.name) for r in exact_dedup.block_names(df, 1).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (names[i] == names[j]) == (a == b)


def test_clashing_names_and_empty_table(spark):
    rows = with_extra(documents(3, 5))
    df = spark.createDataFrame(rows, DOCS + EXTRA)
    got = exact_dedup.exact_groups(df, carry=[c for c in df.columns if c != "kept"])
    assert got.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "kept"]
    assert Counter((r.doc_id, r.text, r.uid, r["a.b"]) for r in got.collect()) == Counter((r[0], r[1], "u", "ab") for r in rows)
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0
