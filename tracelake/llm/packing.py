"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most ``max_tokens`` ids; only longer ones are cut.  The pieces are sorted by
length, and so are the gaps that sequences have left.  In each superstep the pieces of the largest remaining
length look for their successor among the gaps, the smallest that holds them; pieces that want the same gap
are told apart by their rank, a gap takes as many of them as fit, the gaps are updated, and the next length
follows; what finds no gap opens new sequences.  This is best-fit decreasing.

The sweep works on the run-length form of both sorted orders: there are at most ``max_tokens`` lengths and gap
sizes, so its table is bounded by that parameter and not by the corpus.  Counting lengths, ranking pieces and
assigning their places are Spark jobs over all rows; a frequent length is ranked in salted parts.

A null text counts as empty: its only id is the end id.  Repeated rows are packed each.  An empty table gives an
empty result.  Input columns beside id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tracelake.llm.common import col, give_back, stash

MAX_TOKENS, END_ID = 4096, 1
#: Runs whose ids a worker remembers, characters looked up at a time, and rows of a length that are ranked together.
CACHE_RUNS, PART_CHARS, RANK_ROWS = 400_000, 500_000, 50_000


def _classes() -> tuple[re.Pattern, re.Pattern]:
    """Texts of Latin characters whose lower case is one character, and their runs as the tokenizer splits them."""
    latin = [chr(c) for c in range(0x180) if c != 0x130]
    space = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0)]
    kind = lambda k: "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == k)
    letters, digits = kind("L"), kind("N")
    # fixed value: the tokenizer's pattern, with its classes spelled out for these characters
    runs = f"[{letters}]+|[{digits}]|'s|'t|'re|'ve|'m|'ll|'d|[^{letters}{digits}{''.join(map(re.escape, space))}]+"
    return re.compile("[" + "".join(map(re.escape, latin)) + "]*"), re.compile(runs)


def _shape(config: dict) -> list:
    """What decides how a tokenizer splits texts."""
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (config["normalizer"] or {}).get("normalizers", [])]
    split = [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("use_regex")) for p in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return [steps, split, config["model"].get("end_of_word_suffix"), config["model"].get("dropout")]


# fixed value: the shape of the tokenizer that runs are cut for
SHAPE = [
    [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)],
    [("Split", {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "Removed", True, None), ("ByteLevel", None, None, None, False)],
    "</w>",
    None,
]


class WordIds:
    """Ids of texts by a tokenizer of the file at ``path``.

    A tokenizer of another ``SHAPE`` encodes whole texts.  One of this shape lower-cases, drops white space and never
    joins what it splits, so what it has split once is remembered.  It splits texts into runs of letters, single digits and runs of signs, and marks the last id of each run.  So a text is
    cut into its runs here, unknown runs are encoded together, and the marks say where each ends.  What holds other
    characters than Latin ones is encoded as a whole, from white space to white space.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.splits = _shape(config) == SHAPE
        # for runs, which are cut and in lower case already: the same merges without the steps before them
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.latin, self.run = _classes()
        self.known: dict[str, bytes] = {}

    def _runs(self, text: str) -> list[str]:
        if self.latin.fullmatch(text) and "<|" not in text:
            return self.run.findall(text.lower())
        out = []
        for word in text.encode("utf-8", "replace").split():  # ASCII white space; the tokenizer sees to the rest
            w = word.decode()
            if self.latin.fullmatch(w) and "<|" not in w:
                out += self.run.findall(w.lower())
            else:
                out.append(w)
        return out

    def _learn(self, runs: list[str]) -> None:
        plain = [r for r in runs if self.latin.fullmatch(r) and "<|" not in r]
        parts = [plain[at : at + 2000] for at in range(0, len(plain), 2000)]
        for some, found in zip(parts, self.merges.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (4 * np.append(0, ends)).tolist()
                self.known.update((r, raw[a:b]) for r, a, b in zip(some, cuts, cuts[1:], strict=False))
            else:
                self._learn_each(some)
        self._learn_each([r for r in runs if r not in self.known])

    def _learn_each(self, texts: list[str]) -> None:
        for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.known[t] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.splits:
            for t in texts:
                yield np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
            return
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < PART_CHARS:
                held.append(self._runs(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            if len(self.known) > CACHE_RUNS:
                self.known.clear()
            missing = set(filterfalse(self.known.__contains__, chain.from_iterable(held)))
            if missing:
                self._learn(sorted(missing))
            get = self.known.__getitem__
            for runs in held:
                yield b"".join(map(get, runs))


@cache
def _words(path: str) -> WordIds:
    """One for all tasks of a Python worker, so that what one has learned serves the next."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32 bits)."""
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(col(id).alias("doc_id"), col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch["doc_id"], words.ids(list(batch["text"])), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)
            give_back()

    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, ids binary").fields])
    columns = schema.names
    return rows.mapInPandas(cut, schema)


def best_fit(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> np.ndarray:
    """The places of all pieces, from how many there are of each length.

    Rows (length, first rank, pieces per sequence, first sequence, offset), sorted: the piece with rank r among those
    of its length is in sequence ``first + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs (first sequence, how many)
    holds = 0  # bit f: there is a gap of f tokens
    places, sequences = [], 0

    def keep(free: int, first: int, n: int) -> None:
        nonlocal holds
        if free and n:
            gaps.setdefault(free, []).append((first, n))
            holds |= 1 << free

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if fitting := holds >> length:
                free = length + (fitting & -fitting).bit_length() - 1
                first, n = gaps[free].pop()
                if not gaps[free]:
                    holds ^= 1 << free
            else:
                free, first, n = max_tokens, sequences, -(-left // (max_tokens // length))
                sequences += n
            per = free // length
            full = min(n, left // per)
            used = 0
            for m, k in ((full, per), (min(1, n - full), left - full * per)):  # sequences, pieces in each
                if m and k:
                    places.append((length, rank, k, first + used, max_tokens - free))
                    rank, left, used = rank + m * k, left - m * k, used + m
                    keep(free - k * length, first + used - m, m)
                if used == n:
                    break
            keep(free, first + used, n - used)
    return np.array(sorted(places), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of :func:`token_pieces` with sequence_id and offset: no sequence overlaps, none has a hole."""
    pieces = token_pieces(docs, tokenizer, id, text, max_tokens, end_id, with_ids)
    pieces = stash(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    places = best_fit(counts, max_tokens)
    parts = {length: -(-n // RANK_ROWS) for length, n in counts.items() if n > RANK_ROWS}
    salt = F.lit(0)
    if parts:
        many = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        salt = F.pmod(F.xxhash64("uid"), F.coalesce(F.element_at(many, F.col("length")), F.lit(1)).cast("long")).cast("int")
    rows = pieces.withColumn("salt", salt)
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    rows = rows.withColumn("within", within).join(sizes, ["length", "salt"])
    rows = rows.withColumn("rank", F.col("within") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        # the last place of the same length that begins at or before the rank
        lo, hi = np.searchsorted(places[:, 0], n), np.searchsorted(places[:, 0], n, side="right")
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            right = places[mid, 1] <= r
            lo, hi = np.where(right & (hi - lo > 1), mid, lo), np.where(~right & (hi - lo > 1), mid, hi)
        _, first, per, sequence, offset = places[lo].T
        k = r - first
        return pd.DataFrame({"sequence_id": sequence + k // per, "offset": offset + k % per * n})

    rows = rows.withColumn("at", place("length", "rank"))
    extra = ["ids"] if with_ids else []
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *extra)
