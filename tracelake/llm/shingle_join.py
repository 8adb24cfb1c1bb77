"""Near-duplicates by the Jaccard similarity of their word shingles, found by an exact set-similarity join.

Two texts are linked if their sets of word shingles have a Jaccard similarity of at least ``LEVEL``.

First come fingerprints and the binary tries joined with themselves under a Hamming budget (``simhash``), here over the
shingles of this module: every text of a group is checked against the first of the group, shingle by shingle.

A budget of a few bits does not reach all texts that similar, and one that does would compare nearly all fingerprints.  So
an exact join follows, for what the tries have not connected.  The shingles of every text are put into one global order.  Two sets that similar share a shingle among the first
``n - ceil(LEVEL * n) + 1`` of each (prefix filter), so texts that share none there are never compared, and no link is
lost.  Sizes, positions and the number of shingles that two prefixes share rule out more pairs; what is left is compared
shingle by shingle.  Any global order is right;
shingles that are frequent in a sample come last, so that common passages make no candidates.

Large lists of texts behind one shingle are first compared with a few of their members only.  Then the pairs that are
not known to be connected are compared, so a dense group costs no quadratic number of pairs; a sketch of every set rules
out most pairs of a list whose texts share a passage and little else before they are made, and a pair is made in the first of
the lists that hold both of its texts only.

Words are split at ASCII white space, ASCII letters in lower case.  A text of fewer words than a shingle is one shingle;
null and empty texts are equal.  Repeated rows give repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import col, drop, give_back, others, stash, unused
from tracelake.llm.simhash import BUDGET, components, fingerprint, trie_links

SHINGLE, SEED = 5, 42
#: The least similarity, as numerator and denominator.
LEVEL = (4, 5)
#: Of the sample that orders the shingles: one text in so many, the count from which one is frequent, and how many are
#: remembered.  It decides what is compared first and how long lists get, never which links are found.
SAMPLE_SHARE, FREQUENT, FREQUENT_ROWS = 8, 4, 400_000
#: Members of a list that all others are compared with at first, and members that are all compared with each other.
HUBS, SMALL = 4, 32
#: 64-bit words of a sketch, by which most pairs of a large list are ruled out before they are made (texts of up to about a
#: thousand words; longer ones pass it).
SKETCH = 8
#: Large lists that a member remembers of those before, so that a pair that met in one of them is not made again.
EARLIER = 64
#: Bits of the filter for texts that occur in a pair.
FILTER_BITS = 1 << 22


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """The shingles of a text in their order, with repetitions; at least one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(size, len(words))
    if k < size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def hashed(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    found = shingles(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)).view(np.int64))


def prefix(text: str | None, frequent: np.ndarray, place: np.ndarray, size: int = SHINGLE, level: tuple[int, int] = LEVEL) -> tuple[np.ndarray, int]:
    """The first hashes of a text in the global order that a similar text can share first, and how many it has.

    frequent: sorted hashes that come last, in the order of their ``place``.
    """
    h = hashed(text, size)
    n, (num, den) = len(h), level
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        last = frequent[at] == h
        h = np.concatenate([h[~last], h[last][np.argsort(place[at[last]])]])
    return h[: n - (num * n + den - 1) // den + 1], n


def similar(a: set, b: set, level: tuple[int, int] = LEVEL) -> bool:
    both = len(a & b)
    return both * level[1] >= level[0] * (len(a) + len(b) - both)


def _frequent(rows: DataFrame, size: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that a sample holds most often, and their places from rare to frequent."""
    taken = rows.where(F.pmod(F.xxhash64("uid"), F.lit(share)) == 0).select("text")

    def each(batches):
        for batch in batches:
            parts = [hashed(t.as_py(), size) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))], ["sig"])

    counts = taken.mapInArrow(each, "sig long").groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "sig").limit(FREQUENT_ROWS).collect()
    sig = np.array([r["sig"] for r in top], np.int64)
    order = np.argsort(sig)
    return sig[order], -order


def postings(rows: DataFrame, size: int = SHINGLE, level: tuple[int, int] = LEVEL, sample: int = SAMPLE_SHARE) -> DataFrame:
    """(uid, text) to the prefixes: sig, uid, n (shingles of the text), at (position of sig)."""
    frequent, place = _frequent(rows, size, sample)

    def each(batches):
        for batch in batches:
            got = [prefix(t.as_py(), frequent, place, size, level) for t in batch["text"]]
            lens = np.array([len(p) for p, _ in got], np.int64)
            sig = np.concatenate([p for p, _ in got]) if got else np.zeros(0, np.int64)
            n = np.repeat(np.array([n for _, n in got], np.int64), lens)
            at = np.arange(len(sig)) - np.repeat(np.cumsum(lens) - lens, lens)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(batch["uid"].to_numpy(), lens)), pa.array(n), pa.array(at)], ["sig", "uid", "n", "at"])
            give_back()

    return rows.select("uid", "text").mapInArrow(each, "sig long, uid long, n long, at long")


def _met(left: DataFrame, right: DataFrame, where, level: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of members of one list that sizes allow and for which ``where`` holds, a row for each list they meet in.

    Of each pair also the shingles na and nb, what is left of both from the shared shingle on (rest), and whether the list is
    one of few members.
    """
    num, den = level
    a, b = left.alias("a"), right.alias("b")
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    pair = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (least * den >= most * num) & where)
    ordered = F.col("a.uid") < F.col("b.uid")
    pair = pair.select(
        F.least("a.uid", "b.uid").alias("a"), F.greatest("a.uid", "b.uid").alias("b"), F.when(ordered, F.col("a.n")).otherwise(F.col("b.n")).alias("na"),
        F.when(ordered, F.col("b.n")).otherwise(F.col("a.n")).alias("nb"), F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")).alias("rest"), F.col("a.few").cast("int").alias("few"),
    )
    return pair


def _pairs(met: DataFrame) -> DataFrame:
    """A row for each pair: rest from the first shared shingle on, few the lists of few members they meet in."""
    return met.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("rest").alias("rest"), F.sum("few").alias("few"))


def _with_earlier(members: DataFrame, earlier: int) -> DataFrame:
    """Each member of a list with the lists it is in before this one, in the global order; the last ``earlier`` of them."""
    return members.withColumn("before", F.collect_list("sig").over(Window.partitionBy("uid").orderBy("at").rowsBetween(-earlier, -1)))


def _shared(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs, with few as the number of lists that hold both."""
    held = members.groupBy("uid").agg(F.collect_list("sig").alias("held"))
    for k in "ab":
        pairs = pairs.join(held.select(F.col("uid").alias(k), F.col("held").alias(f"h{k}")), k)
    return pairs.withColumn("few", F.size(F.array_intersect("ha", "hb"))).drop("ha", "hb")


def _can_be(pairs: DataFrame, lists: DataFrame | None, level: tuple[int, int]) -> DataFrame:
    """The pairs that enough of what is known of their prefixes allows.

    All shared shingles up to the end of one of the prefixes are in both, and beyond it that set has one less than it must
    share.  What two prefixes share is in lists that hold both: small ones were counted, of large ones there are at most
    as many as the one of the two has that has fewer.  Without ``lists`` all of them were counted.
    """
    num, den = level
    both, unseen = F.col("few"), F.lit(0)
    if lists is not None:
        wide = lists.where("NOT few").groupBy("uid").agg(F.count("*").alias("wide"))
        for k in "ab":
            pairs = pairs.join(wide.select(F.col("uid").alias(k), F.col("wide").alias(f"w{k}")), k, "left")
        unseen = F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0)))
    must = lambda n: F.floor((F.col(n) * num + den - 1) / den)
    most = both + unseen + F.greatest(must("na"), must("nb")) - 1
    # where no list was left out, the first shared shingle is known, and no more than what follows it can be shared
    most = F.when(unseen == 0, F.least(most, F.col("rest"))).otherwise(most)
    return pairs.where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def trie_checked(rows: DataFrame, size: int = SHINGLE, level: tuple[int, int] = LEVEL, paths: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """Links (a, b) of similar texts whose fingerprints the tries connect: each text with the first of its group, where they are similar."""
    paths = [] if paths is None else paths
    prints = stash(rows.select("uid", fingerprint(F.col("text"), size).alias("fp")), "near-prints", paths=paths)
    roots = components(trie_links(prints.select("fp").distinct(), budget), paths)
    groups = prints.join(roots, prints["fp"] == roots["node"], "left").select("uid", F.coalesce("root", "fp").alias("root"))
    groups = stash(groups, "near-tries", paths=paths)
    first = groups.groupBy("root").agg(F.min("uid").alias("a"), F.count("*").alias("n")).where("n > 1").select("root", "a")
    pairs = groups.join(first, "root").where("uid <> a").select("a", F.col("uid").alias("b"))
    return _verified(stash(pairs, "near-tried", paths=paths), rows, size, level, paths)


def _settled(pairs: DataFrame, found: DataFrame, rows: DataFrame, size: int, level: tuple[int, int], paths: list[str]) -> DataFrame:
    """``found`` (links) with links that connect all that the pairs connect; no pair lies within one component of ``found``.

    Every text is first checked against one other, then against one of each component.  What that connects needs no second look, so a group
    of many copies costs about as many checks as it has members; the last round checks all that is left.
    """
    for by in (["b"], ["b", "ra"], None):
        if by != ["b"]:
            pairs = _apart(pairs, components(found, paths), paths)
            if not pairs.head(1):
                return found
        chosen = pairs if by is None else pairs.groupBy(*by).agg(F.min("a").alias("a"))
        new = _verified(chosen.select("a", "b"), rows, size, level, paths)
        found = found.unionByName(new)
    return found


def _apart(pairs: DataFrame, roots: DataFrame, paths: list[str]) -> DataFrame:
    """The pairs whose ends are not in one component yet, and the root ra of a."""
    roots = stash(roots, "near-roots", paths=paths)
    pairs = pairs.select("a", "b")
    for k in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")), k, "left")
    root = lambda k: F.coalesce(F.col(f"r{k}"), F.col(k))
    return stash(pairs.where(root("a") != root("b")).select("a", "b", root("a").alias("ra")), "near-apart", paths=paths)


def _texts_of(uids: DataFrame, rows: DataFrame) -> DataFrame:
    """(uid, text) of the given texts, and few others: a filter of bits is read before anything is moved."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = np.zeros(FILTER_BITS, bool)
    bits[uids.select(slot("uid").alias("k")).distinct().toPandas()["k"].to_numpy(np.int64)] = True
    packed = np.packbits(bits)

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        at = k.to_numpy(np.int64)
        return pd.Series((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return rows.select("uid", "text").where(maybe(slot("uid")))


def sketch(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """``SKETCH`` words of bits; bit k is the parity of the number of shingles whose hash falls on k."""
    slots = (hashed(text, size) & (64 * SKETCH - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """(uid, text) to uid and the words of its sketch."""

    def each(batches):
        for batch in batches:
            words = np.array([sketch(t.as_py(), size) for t in batch["text"]], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch["uid"], *[pa.array(words[:, k]) for k in range(SKETCH)]], ["uid", *[f"w{k}" for k in range(SKETCH)]])
            give_back()

    return texts.mapInArrow(each, "uid long, " + ", ".join(f"w{k} long" for k in range(SKETCH)))


def _sketches_allow(level: tuple[int, int]):
    """Of a pair (a, b) of list members: their sketches differ in no more bits than similar sets differ in shingles.

    A shingle that only one of two sets has changes one bit of one sketch, so differing bits are never more than such shingles.
    """
    num, den = level
    bits = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.w{k}").bitwiseXOR(F.col(f"b.w{k}"))) for k in range(SKETCH)])
    return bits * (num + den) <= (F.col("a.n") + F.col("b.n")) * (den - num)


def _verified(pairs: DataFrame, rows: DataFrame, size: int, level: tuple[int, int], paths: list[str]) -> DataFrame:
    """The pairs whose texts are similar.  Only texts of a pair are moved."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("uid")), rows)

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        cut = functools.lru_cache(16)(lambda t: frozenset(shingles(t, size)))
        out = pd.Series([similar(cut(s), cut(t), level) for s, t in zip(x, y, strict=True)], dtype=bool)
        give_back()
        return out

    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("y"))
    return stash(pairs.join(left, "a").join(right, "b").where(near("x", "y")).select("a", "b"), "near-links", paths=paths)


def links(rows: DataFrame, size: int = SHINGLE, level: tuple[int, int] = LEVEL, sample: int = SAMPLE_SHARE, hubs: int = HUBS, small: int = SMALL, paths: list[str] | None = None, earlier: int = EARLIER) -> DataFrame:
    """(uid, text) to links (a, b) of similar texts; they connect all that are linked by any chain of similar texts."""
    paths = [] if paths is None else paths
    order, all_ = Window.partitionBy("sig").orderBy("uid"), Window.partitionBy("sig")
    lists = postings(rows, size, level, sample).withColumns({"k": F.row_number().over(order), "len": F.count("*").over(all_)})
    lists = stash(lists.where("len > 1").withColumn("few", F.col("len") <= max(hubs, small)).drop("len"), "near-lists", paths=paths)
    at_first = (F.col("a.k") <= hubs) | (F.col("b.k") <= small)
    pairs = stash(_pairs(_met(lists.where(F.col("k") <= max(hubs, small)), lists, (F.col("a.k") < F.col("b.k")) & at_first, level)), "near-pairs", paths=paths)
    likely = stash(_can_be(pairs, lists, level), "near-likely", paths=paths)
    found = trie_checked(rows, size, level, paths)
    if found.head(1):
        likely = _apart(likely, components(found, paths), paths).select("a", "b")
    found = _settled(likely, found, rows, size, level, paths)
    members = lists.where("NOT few")
    if not members.head(1):
        return found
    # of each large list, the members outside its largest component meet all that are in another component
    roots = components(found, paths).withColumnRenamed("node", "uid")
    members = stash(members.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "near-members", paths=paths)
    parts = members.groupBy("sig", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("sig").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    known = stash(_sketches(_texts_of(members.select("uid"), rows), size), "near-sketches", paths=paths)
    apart = stash(_with_earlier(members.join(main, "sig"), earlier).join(known, "uid"), "near-outside", paths=paths)
    minor = apart.where("root <> main")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.k") < F.col("b.k"))
    done = (F.least("a.k", "b.k") <= hubs) | (F.greatest("a.k", "b.k") <= small)
    # all lists that hold a pair not compared yet are large and among these: the first of them makes it, to later ones it has met
    first = ~F.arrays_overlap("a.before", "b.before")
    met = _met(minor, apart, (F.col("a.root") != F.col("b.root")) & once & ~done & _sketches_allow(level) & first, level)
    new = stash(_pairs(met).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "near-new", paths=paths)
    rest = stash(_can_be(_shared(new, apart), None, level), "near-pairs", paths=paths)
    return _settled(rest, found, rows, size, level, paths)


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, level: tuple[int, int] = LEVEL, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of every row with component_id and kept.

    component_id is the smallest id of the component, kept holds for one of the rows with it.  An input column with one of
    these names gives way to the new one.
    """
    carry = others(list(docs.columns) if carry is None else carry, ["component_id", "kept"])
    paths: list[str] = []
    names = {c: unused(docs, f"_sj{k}") for k, c in enumerate(carry) if c != text}
    body = col(text).cast("string").alias("text")
    rows = stash(docs.select(*[col(c).alias(n) for c, n in names.items()], col(id).alias("_id"), body, F.monotonically_increasing_id().alias("uid")), "near-rows")
    roots = components(links(rows.select("uid", "text"), size, level, paths=paths), paths)
    roots = stash(roots.union(roots.select("root", "root").distinct()), "near-roots", paths=paths)
    ids = rows.select("uid", F.col("_id").alias("of")).join(roots, F.col("uid") == F.col("node"))
    first = F.min(F.struct(F.col("of").isNull().alias("none"), F.col("of").alias("id"), F.col("uid").alias("uid")))
    groups = ids.groupBy("root").agg(first.alias("first"))
    # as a table of known size: the texts are shuffled to it only where it is too large to be sent to them
    of = stash(roots.join(groups, "root").select(F.col("node").alias("uid"), F.col("first.id").alias("low"), F.col("first.uid").alias("low_uid")), "near-groups")
    drop(docs.sparkSession, paths)
    out = rows.join(of, "uid", "left")
    own = F.col("low_uid").isNull()
    back = [F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else col(names[c]).alias(c) for c in carry]
    return out.select(*back, F.when(own, F.col("_id")).otherwise(F.col("low")).alias("component_id"), (own | (F.col("uid") == F.col("low_uid"))).alias("kept"))
