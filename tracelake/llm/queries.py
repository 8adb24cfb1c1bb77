"""One registered query per operator, over its whole table, and the oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.llm import conversation, decision_list, decontaminate, exact_dedup, language, line_dedup, packing, quality, secrets, simhash, suffix_dedup, warc, whitening
from tracelake.llm.common import read, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return suffix_dedup.without_repeats(docs, carry=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


@query()
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    away = language.held_out(F.col("doc_id"))
    net = language.train(docs, ~away)
    rows = docs.select("doc_id", away.alias("held_out"), language.predicted(F.col("text"), net).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query()
def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    model = quality.train(docs, read(spark, sf, "labels"))
    rows = stash(quality.graded(docs, model).drop("text", "source", "lang"), "graded")
    return quality.decide(rows, quality.sites(rows, model.rate if model else 0.5))


@query()
def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs, benchmark = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    found = decontaminate.contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = decontaminate.hits(F.col("found"))
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("found")).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "found.spans",
    )


@query()
def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    back = secrets.background(docs)
    rows = secrets.scanned(docs, back, secrets.train(docs, back))
    secret = F.filter("findings", lambda f: f["score"] >= secrets.THRESHOLD)
    values = F.array_join(F.array_sort(F.transform(secret, lambda f: f["value"])), chr(10))
    return rows.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"), F.sha2(values.cast("binary"), 256).alias("secrets_sha256"),
        F.transform(secret, lambda f: F.struct(f["start"].alias("start"), f["stop"].alias("stop"), f["score"].alias("score"))).alias("spans"),
    )


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > low THEN low END AS refers_to
FROM f
""")
def op6_legacy_archive(spark: SparkSession, sf: str) -> DataFrame:
    back = warc.archive(warc.arcs_of(read(spark, sf, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query()
def op8_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return simhash.near_groups(docs, carry=["doc_id"]).select("doc_id", "fingerprint", "component_id", "kept")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p AS k FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w WHERE k IS NOT NULL),
g AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE n > 1),
m AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM e GROUP BY doc_id
""")
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_dedup.without_repeated_lines(read(spark, sf, "documents"), carry=["doc_id"])
    return rows.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
""")
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return exact_dedup.exact_groups(docs, carry=["doc_id"])


@query()
def op11_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whiten(read(spark, sf, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query()
def op12_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return decision_list.judged(docs, read(spark, sf, "labels"), carry=["doc_id"])[0]


@query()
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations")
    return conversation.repair(conversation.damaged(rows), rows)
