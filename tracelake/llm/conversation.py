"""Repair of conversation structure: the cheapest edits that make the roles ``(system? (user assistant)+)?``.

Turns are sorted once over all conversations, so that each range part holds consecutive turns and a conversation of any
size spreads over many parts.  What the edits after a turn cost is a vector over four states (nothing yet, after a system
turn, after a user turn, after an assistant turn).  In a part the vectors are computed backward and stored only at every
square root of the length; walking forward, one block at a time is recomputed, and of the edits that cost no more than the
vectors say the ASCII-least is taken.  For a conversation in several parts, each part first says how it maps the vector
at its end to the one at its start (a min-plus matrix) and, once the vectors at its end are known, which state each state
leads to; both are joined over the few parts of a conversation.

Edits of a turn: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn before
it) 2.  Blank and duplicate turns must be deleted; a truncated turn that stays adds 1.  The first fault of a turn counts:
blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the last
character that is no white space ends no sentence).  Duplicates are told by a SHA-256 digest of role and text.

Null roles and texts count as one blank.  Turns without a number come first; rows with the same number are taken by
role, then text (its first 64 characters, then its digest), so the result does not depend on the order of rows, and repeated
rows are duplicates.  A null conversation id is a conversation of its own.  Extra columns are ignored.  Only the SHA-256 of a
repaired conversation and its audit string need one task per conversation: the one is sequential, the other one value;
the turns are streamed through it.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col, small_batches, stash

#: What edits cost, and what a kept truncated turn adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACES = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
INITIALS = "sua"
#: State after an inserted or reroled turn (user first, then alternating), and its role.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: State after a kept turn by (state, place of the initial in ``INITIALS``).
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: Costs when no turn is left: a user turn alone needs an assistant turn, a system turn needs both.
END = (0, 2 * INSERT, INSERT, 0)
#: Faults as they stand in a code: initial (0-3) + 4 * fault.
SOUND, CUT, GONE = 0, 1, 2


def _inserted(b: list[int]) -> tuple[int, ...]:
    """Costs with insertions before the turn; two of them are enough, as a third only repeats a state."""
    user, other = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return tuple(min(v, NEVER) for v in (min(b[0], INSERT + user), min(b[1], INSERT + user), user, other))


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a turn, insertions included, from that after it."""
    fault, initial = divmod(code, 4)
    out = [DELETE + v for v in after]
    if fault != GONE:
        extra = TRUNCATED * (fault == CUT)
        for s in range(4):
            out[s] = min(out[s], REROLE + extra + after[_NEXT[s]])
            if (s, initial) in _KEPT:
                out[s] = min(out[s], extra + after[_KEPT[s, initial]])
    return _inserted(out)


def edits(code: int, now: tuple[int, ...], after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least tight edits at a turn and the state they lead to."""
    fault, initial = divmod(code, 4)
    extra, done = TRUNCATED * (fault == CUT), ""
    while True:
        if DELETE + after[state] == now[state]:
            return done + "D", state
        if INSERT + now[_NEXT[state]] == now[state]:
            done, state = done + "I", _NEXT[state]
        elif fault != GONE and (state, initial) in _KEPT and extra + after[_KEPT[state, initial]] == now[state]:
            return done + "K", _KEPT[state, initial]
        else:
            return done + "R", _NEXT[state]


def ending(state: int) -> str:
    """Insertions after the last turn."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


class Walker:
    """Backward and forward passes over codes.  Vectors are kept relative to their least entry and numbered, as few differ."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.back: dict[tuple[int, int], int] = {}
        self.step: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def of(self, vector: tuple[int, ...]) -> int:
        least = min(vector)
        own = tuple(v - least if v < NEVER else NEVER for v in vector)
        if own not in self.number:
            self.number[own] = len(self.vectors)
            self.vectors.append(own)
        return self.number[own]

    def before(self, code: int, after: int) -> int:
        got = self.back.get((code, after))
        if got is None:
            got = self.back[code, after] = self.of(before(code, self.vectors[after]))
        return got

    def walk(self, code: int, after: int, state: int) -> tuple[str, int, int]:
        got = self.step.get((code, after, state))
        if got is None:
            vector = self.vectors[after]
            done, to = edits(code, before(code, vector), vector, state)
            cost = DELETE * done.count("D") + INSERT * done.count("I") + REROLE * done.count("R") + TRUNCATED * (code // 4 == CUT and not done.endswith("D"))
            got = self.step[code, after, state] = done, to, cost
        return got

    def checkpoints(self, codes: bytes, end: int) -> tuple[int, list[int]]:
        """The block length and the vector at the end of each block; only these are stored."""
        size = max(1, math.isqrt(len(codes)))
        stored, at = [], end
        for k in range((len(codes) - 1) // size, -1, -1):
            stored.append(at)
            for code in reversed(codes[k * size : (k + 1) * size]):
                at = self.before(code, at)
        return size, stored[::-1]

    def forward(self, codes: bytes, end: int, state: int) -> tuple[list[str], int, int]:
        """Edits by turn, the state they lead to and their cost, from ``state`` before the first turn."""
        size, stored = self.checkpoints(codes, end)
        out, total = [], 0
        for k, last in enumerate(stored):
            block = codes[k * size : (k + 1) * size]
            after = [last]
            for code in reversed(block[1:]):
                after.append(self.before(code, after[-1]))
            for code, vector in zip(block, reversed(after), strict=True):
                done, state, cost = self.walk(code, vector, state)
                out.append(done)
                total += cost
        return out, state, total


def matrix(codes: bytes) -> list[list[int]]:
    """matrix[s][t]: the least cost from state s before the turns to state t after them."""
    columns = []
    for t in range(4):
        at = tuple(0 if s == t else NEVER for s in range(4))
        for code in reversed(codes):
            at = before(code, at)
        columns.append(at)
    return [[columns[t][s] for t in range(4)] for s in range(4)]


def illegal_pairs(initials: np.ndarray) -> int:
    """Adjacent turns whose initials are not su, ua or au."""
    pair = initials[:-1].astype(np.int64) * 4 + initials[1:]
    return int((~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])).sum())


def _shape(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank_if_null = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return rows.select(col(conv).alias("c"), col(turn).cast("long").alias("t"), blank_if_null(col(role)).alias("role"), blank_if_null(col(text)).alias("text"))


def _order() -> list[Column]:
    """What turns of a conversation are sorted by."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return [F.col("t"), F.left("role", F.lit(64)).alias("r64"), F.left("text", F.lit(64)).alias("t64"), digest.alias("d")]


def turns(rows: DataFrame) -> DataFrame:
    """(c, t, role, text) to the sorted turns without their texts: c, t, part, seq, code, blank, duplicate, truncated.

    seq grows with the order over all conversations; part numbers the range a turn lies in.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select("c", *_order(), place.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"))
    keys = ["c", "t", "r64", "t64", "d", "u"]
    light = light.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    light = stash(light.drop("r64", "t64", "u").withColumn("seq", F.monotonically_increasing_id()), "turns")
    again = light.where("NOT blank").groupBy("c", "d").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("c").alias("c2"), F.col("d").alias("d2"), "first")
    found = light.join(again, F.col("c").eqNullSafe(F.col("c2")) & (F.col("d") == F.col("d2")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    truncated = ~F.col("blank") & ~duplicate & F.col("open")
    fault = F.when(F.col("blank") | duplicate, GONE).when(truncated, CUT).otherwise(SOUND)
    found = found.select(
        "c", "t", F.shiftright("seq", 33).alias("part"), "seq", (F.col("initial") + 4 * fault).cast("byte").alias("code"), "blank", duplicate.alias("duplicate"), truncated.alias("truncated"),
    )
    return stash(found, "turn-codes")


def counts(found: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated.  Numbers are counted once by (conversation, number) first."""
    kinds = ["blank", "duplicate", "truncated"]
    by_turn = found.groupBy("c", "t").agg(*[F.sum(F.col(k).cast("long")).alias(k) for k in kinds])
    gaps = F.coalesce(F.max("t") - F.min("t") + 1 - F.count("t"), F.lit(0)).cast("long")
    return by_turn.groupBy("c").agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in kinds])


def _runs(table: pa.Table):
    """(place of the conversation's first turn, codes) for each conversation of a part, in order."""
    codes = table["code"].to_numpy().astype(np.uint8)
    keys = table["c"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield a, codes[a:b]


def _spread(light: DataFrame) -> DataFrame | None:
    """What conversations in several parts need to know in each part; None if there are none.

    Columns: c, part, v0 to v3 (the vector at the part's end), state (before its first turn), initial (of the turn before,
    -1: none), last.  A part holds at most two such conversations, so this grows with the number of parts only.
    """
    several = light.groupBy("c").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(F.col("c").alias("c2"))
    several = stash(several, "spread-conversations")
    if not several.head(1):
        return None
    own = light.join(several, F.col("c").eqNullSafe(F.col("c2")), "left_semi").select("c", "part", "seq", "code")
    ctype = light.schema["c"].dataType.simpleString()

    def unit(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        part, out = table["part"][0].as_py(), []
        for a, codes in _runs(table):
            out.append((table["c"][a], part, [v for row in matrix(codes.tobytes()) for v in row], int(codes[0]) % 4, int(codes[-1]) % 4))
        c, part, m, first, last = zip(*out, strict=True)
        return pa.table({"c": pa.array([v.as_py() for v in c], table.schema.field("c").type), "part": pa.array(part, pa.int64()), "m": pa.array(m, pa.list_(pa.int64())), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())})

    units = stash(own.groupBy("part").applyInArrow(unit, f"c {ctype}, part long, m array<long>, first long, last long"), "spread-units")

    def vectors(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("part").reset_index(drop=True)
        at, ends = END, [None] * len(found)
        for k in range(len(found) - 1, -1, -1):
            ends[k] = at
            m = found["m"][k]
            at = tuple(min(min(int(m[4 * s + t]) + at[t] for t in range(4)), NEVER) for s in range(4))
            at = tuple(v - min(at) for v in at)
        out = pd.DataFrame({"c": found["c"], "part": found["part"], **{f"v{s}": [e[s] for e in ends] for s in range(4)}})
        out["initial"] = [-1, *found["last"][:-1].tolist()]
        out["last"] = [False] * (len(found) - 1) + [True]
        return out

    ends = stash(units.groupBy("c").applyInPandas(vectors, f"c {ctype}, part long, v0 long, v1 long, v2 long, v3 long, initial long, last boolean"), "spread-ends")

    def leads(table: pa.Table, known: pa.Table) -> pa.Table:
        table, walker = table.sort_by("seq"), Walker()
        of = {r["c"]: r for r in known.to_pylist()}
        out = []
        for a, codes in _runs(table):
            c = table["c"][a].as_py()
            end = walker.of(tuple(of[c][f"v{s}"] for s in range(4)))
            out.append((c, table["part"][a].as_py(), [walker.forward(codes.tobytes(), end, s)[1] for s in range(4)]))
        c, part, to = zip(*out, strict=True)
        return pa.table({"c": pa.array(c, table.schema.field("c").type), "part": pa.array(part, pa.int64()), "to": pa.array(to, pa.list_(pa.int64()))})

    to = own.groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(leads, f"c {ctype}, part long, to array<long>")

    def states(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("part").reset_index(drop=True)
        state, out = 0, []
        for k in range(len(found)):
            out.append(state)
            state = int(found["to"][k][state])
        return pd.DataFrame({"c": found["c"], "part": found["part"], "state": out})

    found = to.groupBy("c").applyInPandas(states, f"c {ctype}, part long, state long").withColumnsRenamed({"c": "c2", "part": "part2"})
    return stash(ends.join(found, F.col("c").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("part2"))).drop("c2", "part2"), "spread-states")


def audits(light: DataFrame) -> DataFrame:
    """Per conversation: audit, cost and illegal."""
    spread = _spread(light)
    ctype = light.schema["c"].dataType.simpleString()

    def walk(table: pa.Table, known: pa.Table | None = None) -> pa.Table:
        table, walker = table.sort_by("seq"), Walker()
        of = {r["c"]: r for r in known.to_pylist()} if known is not None else {}
        whole = {"v0": END[0], "v1": END[1], "v2": END[2], "v3": END[3], "state": 0, "initial": -1, "last": True}
        out = []
        names = table["c"]
        for a, codes in _runs(table):
            c = names[a].as_py()
            k = of.get(c, whole)
            done, state, cost = walker.forward(codes.tobytes(), walker.of(tuple(k[f"v{s}"] for s in range(4))), k["state"])
            rest = ending(state) if k["last"] else ""
            initials = codes % 4 if k["initial"] < 0 else np.append(np.uint8(k["initial"]), codes % 4)
            out.append((c, table["part"][0].as_py(), "".join(done) + rest, cost + INSERT * len(rest), illegal_pairs(initials)))
        c, part, audit, cost, illegal = zip(*out, strict=True) if out else ((),) * 5
        return pa.table({"c": pa.array(c, table.schema.field("c").type), "part": pa.array(part, pa.int64()), "audit": pa.array(audit, pa.string()), "cost": pa.array(cost, pa.int64()), "illegal": pa.array(illegal, pa.int64())})

    schema = f"c {ctype}, part long, audit string, cost long, illegal long"
    by_part = light.select("c", "part", "seq", "code").groupBy("part")
    pieces = by_part.applyInArrow(lambda t: walk(t), schema) if spread is None else by_part.cogroup(spread.groupBy("part")).applyInArrow(lambda t, k: walk(t, k), schema)
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "")
    return pieces.groupBy("c").agg(in_order.alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))


def facts(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: c, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    small_batches(rows.sparkSession)
    light = turns(_shape(rows, conv, turn, role, text))
    found = audits(light).withColumnRenamed("c", "c2")
    both = counts(light).join(found, F.col("c").eqNullSafe(F.col("c2")))
    return both.select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of the repaired conversations: c, position (from 1), edit, turn (null: inserted), role, text.

    found: the conversations with their audits (of ``facts``; others have no turn).  Every conversation of ``found`` starts with a
    row of position 0 whose text is null, so that one without turns is seen.  The rows of a conversation are consecutive.
    """
    shaped = _shape(rows, conv, turn, role, text)
    keys = ["t", "r64", "t64", "d"]
    body = shaped.select("c", F.lit(1).alias("kind"), *_order(), "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("c", F.lit(0).alias("kind"), *[F.lit(None).cast(body.schema[k].dataType).alias(k) for k in [*keys, "role", "text"]], F.coalesce("audit", F.lit("")).alias("audit"))
    both = body.unionByName(heads).repartition("c").sortWithinPartitions("c", "kind", *keys).select("c", "kind", "t", "role", "text", "audit")
    ctype = rows.schema[conv].dataType.simpleString()
    names = ["c", "position", "edit", "turn", "role", "text"]

    def each(batches):
        audit, last, at, position, state = "", -1, 0, 0, 0
        types = None
        for batch in batches:
            out: list[tuple] = []

            def insert(c):
                nonlocal at, position, state
                position, at = position + 1, at + 1
                out.append((c, position, "I", None, _ROLE[state], ""))  # noqa: B023
                state = _NEXT[state]

            for c, kind, t, r, x, a in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if kind == 0:
                    audit, at, position, state = a, 0, 0, 0
                    last = max(audit.rfind("D"), audit.rfind("K"), audit.rfind("R"))
                    out.append((c, 0, None, None, None, None))
                    continue
                while audit[at] == "I":
                    insert(c)
                edit, at = audit[at], at + 1
                if edit != "D":
                    r = _ROLE[state] if edit == "R" else r
                    state = _NEXT[state] if edit == "R" else _KEPT[state, INITIALS.index(r[0])]
                    position += 1
                    out.append((c, position, edit, t, r, x))
                while last < at < len(audit):
                    insert(c)
            types = types or [batch.schema.field("c").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, y) for v, y in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)], names)

    return both.mapInArrow(each, f"c {ctype}, position long, edit string, turn long, role string, text string")


def digests(turns_: DataFrame) -> DataFrame:
    """Per conversation of ``repaired``: c, repaired_sha256 of its lines ``role:text``.  Turns stream through the hash."""

    def each(batches):
        open_, lines, sha = None, 0, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for c, position, r, x in zip(*[batch[k].to_pylist() for k in ("c", "position", "role", "text")], strict=True):
                if position == 0:
                    if open_ is not None:
                        done.append((open_[0], sha.hexdigest()))
                    open_, lines, sha = (c,), 0, hashlib.sha256()
                    continue
                sha.update((("\n" if lines else "") + f"{r}:{x}").encode("utf-8", "surrogatepass"))
                lines += 1
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in done], batch.schema.field("c").type), pa.array([v[1] for v in done], pa.string())], ["c", "repaired_sha256"])
            kind = batch.schema.field("c").type
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_[0]], kind), pa.array([sha.hexdigest()])], ["c", "repaired_sha256"])

    return turns_.mapInArrow(each, f"c {turns_.schema['c'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, every: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of ``every`` (its ids; those without rows get zeros): facts and repaired_sha256."""
    found = facts(rows, conv, turn, role, text).withColumnRenamed("c", "c2")
    ids = every.select(col(conv).alias("c")).distinct()
    found = ids.join(found, F.col("c").eqNullSafe(F.col("c2")), "left").drop("c2")
    zero = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = stash(found.select("c", *zero, F.coalesce("audit", F.lit("")).alias("audit")), "conversation-facts")
    sha = digests(repaired(rows, found.select("c", "audit"), conv, turn, role, text)).withColumnRenamed("c", "c2")
    return found.join(sha, F.col("c").eqNullSafe(F.col("c2"))).drop("c2").withColumnRenamed("c", conv)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conv:turn`` modulo 20: one row in four is dropped, emptied, cut short, repeated or given to the user."""
    blank_if_null = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank_if_null(col(conv)), F.lit(":"), blank_if_null(col(turn))).cast("binary")), F.lit(20))
    r, t = blank_if_null(col(role)), blank_if_null(col(text))
    own = rows.select(col(conv).alias("c"), col(turn).alias("t"), r.alias("r"), t.alias("x"), kind.alias("k")).where("k <> 0")
    own = own.select("c", "t", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("r")).alias("r"), F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("x", "[.!?]", "")).otherwise(F.col("x")).alias("x"), "k")
    own = own.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return own.select(F.col("c").alias(conv), F.col("t").alias(turn), F.col("r").alias(role), F.col("x").alias(text))
