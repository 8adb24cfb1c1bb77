"""The pipeline against plain versions of its stages, and the registration of the queries."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.helpers import DOCS, prose
from tests.llm.test_decontaminate import brute as leaks, words
from tests.llm.test_packing import best_fit_decreasing, check
from tracelake.llm import decontaminate


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(k, prose(rng, 14)) for k in range(4)]
    docs, labels = [], []
    for k in range(160):
        good = k % 4 != 0
        t = prose(rng, rng.randint(60, 160), "en" if k % 3 else "fr")
        if k % 10 == 1:
            t = t + " " + items[k % 4][1] + " " + prose(rng, 30)
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split())
        docs.append((k, t, "en", f"src{k % 4}", len(t)))
        labels.append((k, int(good), 0))
    docs += [(500 + k, docs[k][1].replace(" ", "  ", 2), "en", "src1", 0) for k in (1, 2, 5)]
    docs += [(600 + k, docs[k][1] + " ing", "en", "src1", 0) for k in (3, 6, 7)]
    docs += [(700, None, None, None, None), (701, None, None, None, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def five_word_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_pipeline_equals_plain_stages(spark, tables):
    folder, docs, items = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    source = spark.read.parquet(f"{folder}/documents.parquet")
    good = stages["quality_classifier"](spark, source, folder)
    assert good.columns == source.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert all((k in kept) == (k % 4 != 0) for k in range(160))
    # exact copies: smallest id stays
    first = {}
    for k in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[k] or ""), k)
    kept = {k: kept[k] for k in first.values()}
    # near copies (five-word shingles, Jaccard 0.8 or more): smallest id of a component stays
    sets = {k: five_word_shingles(t) for k, t in kept.items()}
    of = {k: k for k in kept}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    assert any(k != v for k, v in of.items())
    kept = {k: t for k, t in kept.items() if of[k] == k}
    # benchmark passages are cut out
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for k, text in kept.items():
        n, hit, _ = leaks(text, items, decontaminate.WIDTH)
        if hit and hit == n:
            continue
        if hit:
            w = words(text)
            for _, body in items:
                v = words(body)
                at = next((i for i in range(len(w)) if w[i : i + len(v)] == v), None)
                if at is not None:
                    parts = re.split(r"( )", text)
                    text = " ".join([*text.split(" ")[:at], "", *text.split(" ")[at + len(v) :]]) if len(text.split(" ")) == len(w) else "".join(parts)
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[k, s // 4096, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check([(r.sequence_id, r.offset, r.length) for r in got], 4096) == best_fit_decreasing([r.length for r in got], 4096)


def test_stages_on_empty_tables_and_repeated_rows(spark, tables):
    folder, docs, _ = tables
    empty = spark.createDataFrame([], DOCS)
    twice = spark.createDataFrame(docs[:12] + docs[:12], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert corpus_pipeline.exact_dedup_stage(spark, twice, folder).count() == 12
    assert corpus_pipeline.near_dedup(spark, twice, folder).count() <= 12


def test_clashing_columns_are_carried(spark, tables):
    folder, docs, _ = tables
    names = ["kept", "keep_id", "component_id", "text_sha256", "group_size", "uid", "evidence", "score", "a.b", "_in0", "Kept2"]
    wide = spark.createDataFrame([(*r, *["x"] * len(names)) for r in docs[:30] + docs[-8:]], DOCS + "".join(f", `{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        assert 0 < out.where("kept = 'x' AND `a.b` = 'x'").count() == out.count()


def test_whole_pipeline_on_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and {"op6_legacy_archive", "op9_line_dedup", "op10_exact_dedup"} <= set(entry.oracle_sql())


def test_packed_ids_come_from_the_kept_texts(spark, tables):
    folder, _, _ = tables
    rows = entry.queries()["pipeline"](spark, folder)
    assert rows.select(F.count("*")).first()[0] == rows.select("doc_id", "piece").distinct().count()
