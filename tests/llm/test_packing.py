import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, EXTRA, documents, with_extra
from tracelake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def places(counts, limit):
    """Every piece's (sequence, offset, length) from the runs of best_fit."""
    p = packing.best_fit(counts, limit)
    out = []
    for length, n in counts.items():
        mine = p[p[:, 0] == length]
        for rank in range(n):
            _, first, per, seq, off = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            k = rank - first
            out.append((seq + k // per, off + k % per * length, length))
    return out


def check(out, limit):
    seqs = defaultdict(list)
    for s, o, n in out:
        seqs[s].append((o, n))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    return len(seqs)


def best_fit_decreasing(lengths, limit):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            f = min(fits)
            free[free.index(f)] = f - n
        else:
            free.append(limit - n)
    return len(free)


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    limit = rng.choice([7, 20, 64, 4096])
    lengths = [rng.randint(1, rng.choice([limit, max(1, limit // 3)])) for _ in range(rng.randint(0, 300))]
    counts = Counter(lengths)
    out = places(counts, limit)
    assert Counter(n for _, _, n in out) == counts
    assert check(out, limit) == best_fit_decreasing(lengths, limit)


def test_pieces_equal_the_tokenizer(spark):
    rows = documents(6, 20) + [(900, "café Ångström ΟΣ. <|endoftext|> it's 12 3 4 5 x\x1cy ́z", "en", "s", 1)]
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 16):
            part = ids[k : k + 16]
            want[r[0], k // 16, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    df = spark.createDataFrame(with_extra(rows), DOCS + EXTRA)
    got = packing.pack(df, PATH, max_tokens=16, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    n = check([(r.sequence_id, r.offset, r.length) for r in got], 16)
    assert n == best_fit_decreasing([r.length for r in got], 16)


def test_a_frequent_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    rows = [(k, "word", "en", "s", 4) for k in range(100)] + [(k, None, "en", "s", 0) for k in range(100, 130)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), PATH, max_tokens=8).collect()
    assert check([(r.sequence_id, r.offset, r.length) for r in got], 8) == best_fit_decreasing([r.length for r in got], 8)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
