"""SimHash near-dedup: fingerprints, and a binary trie joined with itself.

Fingerprints are 64 bits over the XXH64 of word shingles.  Fingerprints that differ in at most ``budget``
bits are linked.  The distinct fingerprints are put into ``budget + 1`` tries, each rotated so that
another block of bits comes first: two fingerprints within the budget agree in at least one whole block,
so in one of the tries they lie below the same node.  From these nodes on, pairs of nodes are traversed
together, differing bits are added up, and a pair is dropped once it exceeds the budget.  Pairs of nodes
whose fingerprints are known to be connected are dropped too, so a dense group costs no quadratic output:
every task returns a spanning forest.  Components come from alternating star contraction of the forests.

A node with very many fingerprints is cut into pairs of child nodes before it becomes a task.

Null and empty texts have no words and get fingerprint zero, linked like any other.  Repeated rows give
repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, drop, give_back, stash, unused

SHINGLE, BUDGET, BITS, SEED = 4, 4, 64, 42
#: Fingerprints that one task may hold before its node is cut into child nodes, and bits of one cut.
TASK_ROWS, CUT_BITS = 200_000, 6
#: Node pairs that are held at a time, and pairs of leaves below which two nodes are compared outright.
WAVE, LEAVES = 400_000, 16
#: Links that one task of a round of ``components`` takes: few links travel in few tasks, however many parts a shuffle has.
TASK_LINKS = 20_000


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends = ends - lens, ends
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(words) - k + 1
    for at in range(0, n, 65_536):  # bounded memory, however long the text
        spans = zip(starts[at : min(at + 65_536, n)].tolist(), ends[k - 1 :][at : at + 65_536].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        out = pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64))
        give_back()
        return out

    return prints(text.cast("string"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _rotations(budget: int) -> list[tuple[int, int]]:
    """(bits to rotate left, block width) of each trie."""
    edges = [round(k * BITS / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _rotated(fp: Column, by: int) -> Column:
    if not by:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


class Forest:
    """Labels of the rows of one task; the smallest row of a component is its label."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self._runs()

    def _runs(self) -> None:
        change = np.flatnonzero(np.diff(self.label))
        ends = np.append(change + 1, len(self.label))
        self.run_end = np.repeat(ends, np.diff(np.append(0, ends)))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        changed = False
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up
            changed = True
        if changed:
            self._runs()

    def same(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Whether all rows of both ranges are in one component."""
        return (self.run_end[alo] >= ahi) & (self.run_end[blo] >= bhi) & (self.label[alo] == self.label[blo])


def trie_join(left: np.ndarray, right: np.ndarray | None, starts: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Labels of the rows of ``left`` (and ``right`` behind it), sorted unsigned values, after the joint traversal.

    starts: rows (a0, a1, b0, b1, bits already differing) of node pairs at ``depth``; a self-join (right is None)
    has a0 = b0 for the pair of a node with itself.
    """
    own = right is None
    shift = 0 if own else len(left)
    values = left if own else np.concatenate([left, right])
    forest = Forest(len(values))
    stack = [(depth, starts + np.array([0, 0, shift, shift, 0]))]
    one = np.uint64(1)
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > WAVE:
            order = np.argsort(pairs[:, 4], kind="stable")  # few differing bits are taken first
            pairs = pairs[order]
            stack.append((depth, pairs[WAVE:]))
            pairs = pairs[:WAVE]
        pairs = pairs[~forest.same(*pairs.T[:4])]
        if not len(pairs):
            continue
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        small = (na * nb <= LEAVES) | (depth == BITS)
        if small.any():
            p, n, m = pairs[small], na[small], nb[small]
            for at in range(0, len(p), WAVE // LEAVES):
                q, qn, qm = p[at : at + WAVE // LEAVES], n[at : at + WAVE // LEAVES], m[at : at + WAVE // LEAVES]
                area = qn * qm
                who = np.repeat(np.arange(len(q)), area)
                k = np.arange(len(who)) - np.repeat(np.cumsum(area) - area, area)
                a, b = q[who, 0] + k // qm[who], q[who, 2] + k % qm[who]
                near = np.bitwise_count(values[a] ^ values[b]) <= budget
                forest.link(a[near], b[near])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = np.uint64(BITS - 1 - depth)

        def cut(lo: np.ndarray, hi: np.ndarray, bit: np.uint64 = bit) -> np.ndarray:
            first = (values[lo] >> bit | one) << bit
            if own:
                return np.clip(np.searchsorted(values, first), lo, hi)
            inside = np.where(lo < shift, np.searchsorted(left, first), shift + np.searchsorted(right, first))
            return np.clip(inside, lo, hi)

        a0, a1, b0, b1, d = pairs.T
        am, bm = cut(a0, a1), cut(b0, b1)
        self_pair = (a0 == b0) & (a1 == b1)
        kids = [np.stack([a0, am, b0, bm, d], 1), np.stack([am, a1, bm, b1, d], 1), np.stack([a0, am, bm, b1, d + 1], 1), np.stack([am, a1, b0, bm, d + 1], 1)[~self_pair]]
        nxt = np.concatenate(kids)
        nxt = nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)]
        if len(nxt):
            stack.append((depth + 1, nxt))
    return forest.label


def _task(budget: int):
    def join(table: pa.Table) -> pa.Table:
        """One task: its nodes joined with themselves (side 0 only), or two child nodes with each other."""
        rot, width = table["rot"][0].as_py(), table["width"][0].as_py()
        used, depth = table["used"][0].as_py(), table["depth"][0].as_py()
        fp = table["fp"].to_numpy().view(np.uint64)
        value = (fp << np.uint64(rot) | fp >> np.uint64(BITS - rot)) if rot else fp
        side = table["side"].to_numpy()
        parts = [np.unique(value[side == s]) for s in (0, 1)]
        if len(parts[1]):
            a, b = parts
            label = trie_join(a, b, np.array([[0, len(a), 0, len(b), used]]), depth, budget)
            values = np.concatenate(parts)
        else:
            values = parts[0]
            top = values >> np.uint64(BITS - max(width, depth))
            lo = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
            hi = np.append(lo[1:], len(values))
            label = trie_join(values, None, np.stack([lo, hi, lo, hi, np.full(len(lo), used)], 1), max(width, depth), budget)
        child = np.flatnonzero(label != np.arange(len(label)))
        back = lambda v: ((v >> np.uint64(rot) | v << np.uint64(BITS - rot)) if rot else v).view(np.int64)
        return pa.table({"a": back(values[child]), "b": back(values[label[child]])})

    return join


def _cut_large(tasks: DataFrame, keys: list[str], budget: int, rows: int) -> DataFrame:
    """Replace each task of more than ``rows`` fingerprints by the pairs of its child nodes within the budget.

    A task is cut until it is small or its bits are used up; a round only moves the rows of large tasks.
    """
    done = []
    for _ in range(BITS // CUT_BITS):
        sizes = tasks.groupBy(*keys).agg(F.count("*").alias("n"), F.first("depth").alias("at"))
        large = stash(sizes.where((F.col("n") > rows) & (F.col("at") + CUT_BITS <= BITS)).select(*keys), "simhash-large")
        if not large.head(1):
            break
        done.append(tasks.join(large, keys, "left_anti"))
        hot = tasks.join(large, keys, "left_semi")
        turned = F.expr("CASE WHEN rot = 0 THEN fp ELSE shiftleft(fp, rot) | shiftrightunsigned(fp, 64 - rot) END")
        kid = F.expr(f"shiftrightunsigned(v, 64 - depth - {CUT_BITS}) & {2**CUT_BITS - 1}")
        hot = hot.withColumn("v", turned).withColumn("kid", kid)
        hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(2**CUT_BITS - 1))))
        apart = F.bit_count(F.col("kid").bitwiseXOR(F.col("other")))
        hot = hot.where(F.col("used") + apart <= budget)
        # two-sided tasks keep their sides; a one-sided task becomes self tasks (kid = other) and pairs a < b
        two = F.col("two")
        a = F.when(two & (F.col("side") == 1), F.col("other")).when(two, F.col("kid")).otherwise(F.least("kid", "other"))
        b = F.when(two & (F.col("side") == 1), F.col("kid")).when(two, F.col("other")).otherwise(F.greatest("kid", "other"))
        tasks = hot.select(
            "rot", "width", F.concat_ws(".", "node", a, b).alias("node"), (F.col("depth") + CUT_BITS).alias("depth"), (F.col("used") + apart).alias("used"),
            F.when(two, F.col("side")).otherwise((F.col("kid") > F.col("other")).cast("int")).alias("side"), (two | (F.col("kid") != F.col("other"))).alias("two"), "fp",
        )
        tasks = stash(tasks, "simhash-cut")
    else:
        done.append(tasks)
        return _union(done)
    return _union([*done, tasks])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trie_links(prints: DataFrame, budget: int = BUDGET, task_rows: int = TASK_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect what is within the budget: forests of the tasks."""
    n = prints.count()
    tries = []
    for rot, width in _rotations(budget):
        # a task holds neighbouring nodes of a trie, about task_rows / 8 fingerprints
        bits = min(width, max(0, (n * 8 // task_rows).bit_length()))
        node = F.shiftrightunsigned(_rotated(F.col("fp"), rot), BITS - bits) if bits else F.lit(0).cast("long")
        tries.append(prints.select(F.lit(rot).alias("rot"), F.lit(width).alias("width"), node.cast("string").alias("node"), F.lit(bits).alias("depth"), F.lit(0).alias("used"), F.lit(0).alias("side"), F.lit(False).alias("two"), "fp"))
    keys = ["rot", "node"]
    tasks = _cut_large(_union(tries), keys, budget, task_rows)
    return tasks.groupBy(*keys).applyInArrow(_task(budget), "a long, b long")


def components(links: DataFrame, paths: list[str] | None = None, task_links: int = TASK_LINKS) -> DataFrame:
    """Links (a, b) to (node, root), root the smallest node of the component, by alternating star contraction.

    Each round hangs the larger neighbours of every node, then all of its smaller ones, below the smallest
    node around; minima are combined before the shuffle, so a node with very many links is no hot spot.
    Links of a round that is over are deleted.  paths: takes the folder of the last ones, for ``drop``.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def lower(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()

    def state_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    held: list[str] = []
    edges = stash(lower(links), "links", paths=held)
    before = state_of(edges)
    while before[0]:
        tasks = math.ceil(before[0] / task_links)
        slim = lambda e, tasks=tasks: e.coalesce(tasks) if tasks < parts else e
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = slim(slim(both).groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = slim(both).where("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b"))
        near = slim(lower(slim(large)))
        least = slim(near.groupBy("v").agg(F.min("u").alias("m")))
        joined = near.join(least, "v")
        small = joined.select(F.col("u").alias("a"), F.col("m").alias("b")).union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
        over, held = held, []
        edges = stash(slim(lower(slim(small))), "links", paths=held)
        state = state_of(edges)
        drop(links.sparkSession, over)
        if state == before:
            break
        before = state
    if paths is not None:
        paths += held
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of every row with fingerprint (hex), component_id and kept.

    component_id is the smallest id of the component, kept holds for one of the rows with it.
    """
    carry = list(docs.columns) if carry is None else carry
    names = {c: unused(docs, f"_sh{k}") for k, c in enumerate(carry)}
    rows = docs.select(*[col(c).alias(names[c]) for c in carry], col(id).alias("_id"), fingerprint(col(text), shingle).alias("fp"), F.monotonically_increasing_id().alias("uid"))
    rows = stash(rows, "simhash-rows")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("uid").alias("uid")))
    prints = stash(rows.groupBy("fp").agg(first.alias("first")), "simhash-prints")
    roots = components(trie_links(prints.select("fp"), budget))
    prints = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    prints = stash(prints, "simhash-roots")
    groups = prints.groupBy("root").agg(F.min("first").alias("first"))
    groups = prints.select("fp", "root").join(groups, "root").select("fp", "first")
    out = rows.join(groups, "fp")
    return out.select(*[col(names[c]).alias(c) for c in carry], as_hex(F.col("fp")).alias("fingerprint"), F.col("first.id").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("kept"))
