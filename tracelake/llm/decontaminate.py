"""Benchmark decontamination with an FM-index per shard of the training text.

Words are runs of digits, letters and characters beyond ASCII, in lower case.  A benchmark item gives the
windows of ``width`` consecutive words; an item with fewer words, but not none, is one window.  Every shard
of a few MB of whole documents gets an FM-index over its words: suffix array by prefix doubling,
Burrows-Wheeler transform, wavelet matrix with rank counts, and suffix positions sampled at every
``SAMPLE``-th word.  All windows are searched backwards at once; the rows found are walked to the next
sampled position; occurrences are compared with the window's words (hashes only choose the symbols) and merged
into removal spans.

Words that no window holds cannot be part of an occurrence.  They end the runs that the index holds.

A shard is made and searched inside one task, so no text is shuffled, and only windows travel: in blocks of at
most ``BLOCK_WINDOWS``, all rows being searched for each block.

A null text has no words and stays null.  A null item text gives no window, a null item id reads as the
empty string; items with equal ids count once.  Empty tables, on either side, find nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, give_back, unused

WIDTH, SAMPLE, SHARD_BYTES, BLOCK_WINDOWS = 10, 8, 1_000_000, 200_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, independent of where it stands."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Windows(NamedTuple):
    """The windows of one block: joined words, item ids of each, symbols (rows padded on the left with 0)."""

    texts: list[bytes]
    items: list[list[str]]
    hashes: np.ndarray  # of the vocabulary, sorted; symbol k + 1 is hashes[k]
    symbols: np.ndarray
    sizes: np.ndarray


def windows_of(items: list[tuple[str, str]], width: int = WIDTH) -> list[tuple[bytes, list[str]]]:
    """The distinct windows of (item id, text) rows with the ids of their items."""
    by: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            by[b" ".join(words[k : k + width])].add(item)
    return [(w, sorted(by[w])) for w in sorted(by)]


def _block(windows: list[tuple[bytes, list[str]]], width: int) -> Windows:
    vocabulary = sorted({w for text, _ in windows for w in text.split(b" ")})
    joined = b" ".join(vocabulary)
    data = np.frombuffer(joined, np.uint8)
    lens = np.array([len(w) for w in vocabulary], np.int64)
    ends = np.cumsum(lens + 1) - 1
    hashes = _hash_words(data, ends - lens, ends, _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1))
    unique = np.unique(hashes)
    symbol = dict(zip(vocabulary, (np.searchsorted(unique, hashes) + 1).tolist(), strict=True))
    table = np.zeros((len(windows), width), np.int64)
    sizes = np.zeros(len(windows), np.int64)
    for k, (text, _) in enumerate(windows):
        row = [symbol[w] for w in text.split(b" ")]
        table[k, width - len(row) :], sizes[k] = row, len(row)
    return Windows([w for w, _ in windows], [i for _, i in windows], unique, table, sizes)


class FMIndex:
    """Of a sequence of symbols in which 0 ends a run; patterns hold no 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE) -> None:
        n = len(seq)
        stop = seq == 0
        self.bits = max(1, int(seq.max()).bit_length())
        # every end of a run is a symbol of its own, below all words, so suffixes differ at the end of their run
        rank = np.where(stop, np.cumsum(stop) - 1, seq + int(stop.sum()))
        order = np.argsort(rank, kind="stable")
        rank, step = self._ranked(order, rank, np.zeros(n, np.int64)), 1
        while rank[order[-1]] < n - 1:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            order = np.argsort(rank * (n + 1) + after, kind="stable")
            rank, step = self._ranked(order, rank, after), step * 2
        before = np.where(order > 0, order - 1, n - 1)
        self.bwt = seq[before]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1 << self.bits))])
        keep = (order % sample == 0) | (self.bwt == 0)
        self.marked = np.concatenate([[0], np.cumsum(keep)])
        self.kept, self.positions = keep, order[keep]
        self.levels, cur = [], self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            self.levels.append(ones)
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    @staticmethod
    def _ranked(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = a[order], b[order]
        new = np.concatenate([[0], np.cumsum((x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
        out = np.empty(len(a), np.int64)
        out[order] = new
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the row, through the wavelet matrix."""
        lo, hi = np.zeros_like(at), at
        for level, ones in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            zeros = len(ones) - 1 - ones[-1]
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt))
        known = patterns.max(axis=1, initial=0) < len(self.first) - 1
        hi[~known] = 0
        width = patterns.shape[1]
        for k in range(1, width + 1):
            on = np.flatnonzero((sizes >= k) & (hi > lo))
            c = patterns[on, width - k]
            lo[on], hi[on] = self.first[c] + self.rank(c, lo[on]), self.first[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps to the previous word until a sampled one."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            there = self.kept[rows]
            out[open_[there]] = self.positions[self.marked[rows[there]]] + steps
            open_, rows = open_[~there], rows[~there]
            c = self.bwt[rows]
            rows, steps = self.first[c] + self.rank(c, rows), steps + 1
        return out


class Shard:
    """The words of some documents, searched for the windows of a block."""

    def __init__(self, texts: list[str | None], powers: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
        self.data = b"\0".join(raw) + b"\0"
        data = np.frombuffer(self.data, np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _IS_WORD[data], [False]]).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.words = np.searchsorted(self.starts, self.begin)  # first word of each document
        up, down = powers if powers and len(powers[0]) > len(data) else (_powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1))
        self.hashes = _hash_words(data, self.starts, self.ends, up, down)

    def find(self, block: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.starts) or not len(block.texts):
            return none
        at = np.minimum(np.searchsorted(block.hashes, self.hashes), len(block.hashes) - 1)
        symbol = np.where(block.hashes[at] == self.hashes, at + 1, 0)
        doc = np.zeros(len(symbol) + 1, bool)
        doc[self.words] = True  # a run does not go over the end of a document
        first = (symbol > 0) & (np.concatenate([[0], symbol[:-1]]) == 0) | (symbol > 0) & doc[:-1]
        last = (symbol > 0) & (np.concatenate([symbol[1:], [0]]) == 0) | (symbol > 0) & doc[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
        keep = hi - lo >= block.sizes.min()
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            return none
        size = hi - lo + 1
        word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        seq = symbol[np.minimum(word, len(symbol) - 1)]
        seq[np.cumsum(size) - 1] = 0
        index = FMIndex(seq)
        a, b = index.search(block.symbols, block.sizes)
        n = np.maximum(b - a, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        start = word[index.locate(rows)]
        spans = zip(self.starts[start].tolist(), self.ends[start + block.sizes[which] - 1].tolist(), which.tolist(), strict=True)
        same = np.fromiter((b" ".join(WORD.findall(self.data[s:e])) == block.texts[w] for s, e, w in spans), bool, len(which))
        return start[same], which[same]

    def report(self, block: Windows) -> list[tuple[int, list[dict], list[str]]]:
        """Of each document: number of words, merged spans of hit words and bytes, items found."""
        start, which = self.find(block)
        cover = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + block.sizes[which] if len(which) else start, -1)
        hit = np.cumsum(cover) > 0
        hit[-1] = False
        split = np.zeros(len(hit) + 1, bool)
        split[self.words] = True
        lo = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | split[:-1]))
        hi = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]]) | split[1:])) + 1
        owner = np.searchsorted(self.words, lo, side="right") - 1
        spans: dict[int, list[dict]] = defaultdict(list)
        for d, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
            base = int(self.begin[d])
            spans[d].append({"word": a - int(self.words[d]), "words": b - a, "start": int(self.starts[a]) - base, "end": int(self.ends[b - 1]) - base})
        items: dict[int, set[str]] = defaultdict(set)
        docs = np.searchsorted(self.words, start, side="right") - 1
        for d, w in np.unique(np.stack([docs, which], 1), axis=0).tolist():
            items[d].update(block.items[w])
        counts = np.diff(self.words).tolist()
        return [(n, spans.get(d, []), sorted(items.get(d, ()))) for d, n in enumerate(counts)]


FOUND = "n_words long, spans array<struct<word:long,words:long,start:long,end:long>>, items array<string>"


def _search(text: Column, block: Windows, shard_bytes: int) -> Column:
    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        powers = _powers(_BASE, 2 * shard_bytes), _powers(_INVERSE, 2 * shard_bytes)
        rows, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= shard_bytes:
                rows += Shard(part, powers).report(block)
                part, size = [], 0
        rows += Shard(part, powers).report(block) if part else []
        give_back()
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return search(text)


def _merged(n_words: Column, spans: Column, items: Column) -> Column:
    """What several blocks have found, as one."""
    return F.pandas_udf(_merge, FOUND)(n_words, spans, items)


def _merge(n_words: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    rows = []
    for n, parts, found in zip(n_words, spans, items, strict=True):
        out: list[dict] = []
        for s in sorted(map(dict, parts), key=lambda s: (s["word"], -s["words"])):
            if out and s["word"] <= (end := out[-1]["word"] + out[-1]["words"]):
                if s["word"] + s["words"] > end:
                    out[-1] |= {"words": s["word"] + s["words"] - out[-1]["word"], "end": s["end"]}
            else:
                out.append(s)
        rows.append((n, out, sorted(set(found))))
    return pd.DataFrame(rows, columns=["n_words", "spans", "items"])


def without(text: Column, spans: Column) -> Column:
    """The text without the bytes of the spans."""
    return F.pandas_udf(_cut, "string")(text.cast("string"), spans)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, cut in zip(texts, spans, strict=True):
        if t is not None and len(cut):
            raw, at, keep = t.encode("utf-8", "replace"), 0, []
            for s in cut:
                keep.append(raw[at : s["start"]])
                at = s["end"]
            t = b"".join([*keep, raw[at:]]).decode("utf-8", "replace")
        out.append(t)
    return pd.Series(out, dtype=object)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES, block_windows: int = BLOCK_WINDOWS, as_: str = "found") -> DataFrame:
    """``docs`` with a struct ``as_``: n_words, spans (words and UTF-8 bytes) and items (ids as strings, sorted)."""
    rows = benchmark.select(F.coalesce(col(item).cast("string"), F.lit("")).alias("i"), col(item_text).cast("string").alias("t")).where("t IS NOT NULL").toLocalIterator()
    parts, held, blocks = [], [], 0
    body, out = col(text).cast("string"), docs

    def search(found: list[tuple[str, str]], out: DataFrame) -> DataFrame:
        name = unused(out, f"_found{blocks}")
        parts.append(name)
        return out.withColumn(name, _search(body, _block(windows_of(found, width), width), shard_bytes))

    size = 0
    for r in rows:  # one block of items at a time
        held.append((r["i"], r["t"]))
        size += r["t"].count(" ") + 1
        if size >= block_windows:
            out, held, size, blocks = search(held, out), [], 0, blocks + 1
    if held or not parts:
        out = search(held, out)
    if len(parts) == 1:
        return out.withColumnRenamed(parts[0], as_)
    field = lambda f: F.array(*[col(p)[f] for p in parts])
    return out.withColumn(as_, _merged(field("n_words")[0], F.flatten(field("spans")), F.flatten(field("items")))).drop(*parts)


def hits(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["words"])


def items_digest(found: Column) -> Column:
    return F.sha2(F.array_join(found["items"], ",").cast("binary"), 256)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` without the spans found; a document none of whose words is left goes, unless it had none before."""
    name = unused(docs, "_found")
    rows = contamination(docs, benchmark, text, as_=name, **options)
    rows = rows.where((hits(col(name)) == 0) | (hits(col(name)) < col(name)["n_words"]))
    rows = rows.withColumn(text, without(col(text), col(name)["spans"]))
    if n_chars in docs.columns:
        cut = F.length(col(text)).cast(docs.schema[n_chars].dataType)
        rows = rows.withColumn(n_chars, F.when(F.size(col(name)["spans"]) > 0, cut).otherwise(col(n_chars)))
    return rows.drop(name)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
