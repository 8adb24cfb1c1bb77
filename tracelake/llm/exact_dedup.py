"""Exact dedup by deterministic block naming, with DataFrame operations only.

A text is cut into blocks of a fixed number of characters.  The distinct blocks are sorted and get
integer names; then adjacent names are paired, the distinct pairs are sorted and named in turn, until
each document has one name.  Two documents have the same (level, name) only if they are the same text,
as every name stands for one string: no hash decides.

Only texts that share length and a 64-bit hash with another one are named; a text whose pair
(length, hash) occurs once differs from all others, so this leaves nothing out.

White space runs (blank, tab to carriage return) count as one blank.  A null text counts as empty.
Of equal texts the row with the smallest id stays; a null id comes after all others, and of rows that
are equal in id and text exactly one stays.  An empty table gives an empty result.  Working columns take
names the input does not have; an input column named like a new one gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, drop, empty_if_null, others, stash, unused

BLOCK = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(empty_if_null(text), r"[\x20\x09-\x0D]+", " ")


def _named(items: DataFrame, keys: list[str], what: str, paths: list[str] | None = None) -> DataFrame:
    """The distinct ``keys`` of ``items`` in sorted order with an integer ``name`` each."""
    ranked = items.select(*keys).distinct().orderBy(*keys)
    return stash(ranked.withColumn("name", F.monotonically_increasing_id()), what, paths=paths)


def block_names(texts: DataFrame, block: int = BLOCK, paths: list[str] | None = None) -> DataFrame:
    """(uid, t) to (uid, level, name): equal (level, name) if and only if equal ``t``."""
    blocks = texts.select("uid", F.posexplode_outer(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))))
    blocks = blocks.select("uid", F.coalesce("pos", F.lit(0)).alias("i"), F.coalesce("col", F.lit("")).alias("s"))
    names = _named(blocks, ["s"], "block-names", paths)
    work = stash(blocks.join(names, "s").select("uid", "i", "name"), "named-blocks", paths=paths)
    longest = work.agg(F.max("i")).first()[0]
    done, level = [], 0
    while longest:
        sizes = work.groupBy("uid").agg(F.max("i").alias("last"))
        work = work.join(sizes, "uid")
        done.append(work.where("last = 0").select("uid", F.lit(level).alias("level"), "name"))
        pairs = work.where("last > 0").groupBy("uid", F.floor(F.col("i") / 2).cast("int").alias("i"))
        # the odd block at the end has no right part: -1 is no name
        pairs = pairs.agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = _named(pairs, ["a", "b"], "pair-names", paths)
        work = stash(pairs.join(names, ["a", "b"]).select("uid", "i", "name"), "named-pairs", paths=paths)
        longest, level = longest // 2, level + 1
    out = work.select("uid", F.lit(level).alias("level"), "name")
    for part in done:
        out = out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of every row with keep_id, group_size, kept and text_sha256."""
    carry = others(list(docs.columns) if carry is None else carry, ["keep_id", "group_size", "kept", "text_sha256"])
    paths: list[str] = []
    names = {c: unused(docs, f"_bn{k}") for k, c in enumerate(carry)}
    t, twin = unused(docs, "_bn_t"), unused(docs, "_bn_twin")
    rows = docs.select(*[col(c).alias(names[c]) for c in carry], col(id).alias("_id"), normalised(col(text)).alias(t))
    rows = rows.withColumns({"_n": F.length(t), "_h": F.xxhash64(t), "_sha": F.sha2(F.col(t).cast("binary"), 256)})
    twins = rows.groupBy("_n", "_h").agg(F.count("*").alias("_c")).where("_c > 1").select("_n", "_h", F.lit(True).alias(twin))
    # as a table of known size: texts are only shuffled to it where it is too large to be sent to them
    twins = stash(twins, "exact-twins", paths=paths)
    rows = rows.join(twins, ["_n", "_h"], "left").withColumn(twin, F.coalesce(twin, F.lit(False)))
    rows = rows.drop("_n", "_h").withColumns({t: F.when(F.col(twin), F.col(t)), "uid": F.monotonically_increasing_id()})
    rows = stash(rows, "exact-rows", twin)
    single = rows.where(~F.col(twin))
    several = rows.where(F.col(twin))
    ids = block_names(several.select("uid", F.col(t).alias("t")), block, paths)
    ids = ids.join(several.select("uid", "_id"), "uid")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("uid").alias("uid"))
    groups = ids.groupBy("level", "name").agg(F.min(first).alias("first"), F.count("*").alias("size"))
    named = stash(ids.join(groups, ["level", "name"]).select("uid", "first", "size"), "exact-groups")
    drop(docs.sparkSession, paths)
    out = [col(names[c]).alias(c) for c in carry]
    a = single.select(*out, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    b = several.join(named, "uid").select(
        *out, F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("uid") == F.col("first.uid")).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    return a.union(b)
