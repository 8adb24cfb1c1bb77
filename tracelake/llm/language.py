"""Language of a document by a bidirectional gated recurrent network over its bytes.

Two GRUs read the UTF-8 bytes forwards and backwards; every position gets a probability for each language, and
a document the mean of its positions.  The network is trained here, in numpy, by backpropagation through time
(Adam) on a bounded sample of labelled rows, of which excerpts from all parts of the text are taken.

Prediction reads whole texts.  They are cut into segments, whose states start anew; many segments are
computed side by side, so memory is bounded however long a text is.

A text that is null or has no letter is ``und`` with score 0, and so is everything where nothing could be
learned.  Null labels are not learned from.  Repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.common import col

HIDDEN, STEPS, BATCH, EPOCH_STEPS, RATE = 8, 64, 128, 320, 0.02
#: Labelled rows of each language and in total that are sampled (by a hash), and excerpts of each row.  Every label is learned.
ROWS_PER_LANGUAGE, TRAIN_ROWS, EXCERPTS = 400, 25_600, 4
#: Bytes of a segment in prediction, and segments computed side by side.
SEGMENT, SIDE_BY_SIDE = 256, 2048
UNDETERMINED = "und"


class Direction(NamedTuple):
    """Input table (3H, 256) with the biases in it, and recurrent weights (3H, H); rows are update, reset, candidate."""

    table: np.ndarray
    back: np.ndarray


class Network(NamedTuple):
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (languages, 2H)
    bias: np.ndarray  # (languages, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(d: Direction, x: np.ndarray, trace: list | None = None, within: np.ndarray | None = None) -> np.ndarray:
    """States (T, H, B) after each byte of x (T, B); outside ``within`` (T, B) the state stays at its start."""
    h_n = d.back.shape[1]
    h = np.zeros((h_n, x.shape[1]), d.back.dtype)
    states = np.empty((len(x), h_n, x.shape[1]), d.back.dtype)
    for t in range(len(x)):
        a = d.table[:, x[t]]
        u = d.back @ h
        gates = _sigmoid(a[: 2 * h_n] + u[: 2 * h_n])
        z, r = gates[:h_n], gates[h_n:]
        n = np.tanh(a[2 * h_n :] + r * u[2 * h_n :])
        if trace is not None:
            trace.append((h, z, r, n, u[2 * h_n :]))
        h = n + z * (h - n)
        if within is not None:
            h = h * within[t]
        states[t] = h
    return states


def _learn(d: Direction, x: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and recurrent weights, from those of the states (T, H, B)."""
    h_n = d.back.shape[1]
    back = np.zeros_like(d.back)
    inputs = np.empty((len(x), 3 * h_n, x.shape[1]), d.back.dtype)
    carried = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, u = trace[t]
        dh = grad[t] + carried
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        inputs[t] = np.concatenate([dz, dr, dn])
        recurrent = np.concatenate([dz, dr, dn * r])
        back += recurrent @ h.T
        carried = dh * z + d.back.T @ recurrent
    flat, rows = x.ravel(), inputs.transpose(1, 0, 2).reshape(3 * h_n, -1)
    table = np.stack([np.bincount(flat, weights=row, minlength=256) for row in rows]).astype(d.table.dtype)
    return table, back


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def fit(excerpts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rounds: int = EPOCH_STEPS, rate: float = RATE, seed: int = 7) -> Network | None:
    """Train on excerpts; every language is drawn equally often, windows of ``steps`` bytes at random."""
    languages = sorted(set(labels))
    pools = [[np.frombuffer(e, np.uint8) for e, k in zip(excerpts, labels, strict=True) if k == name and len(e) >= 4] for name in languages]
    languages, pools = [n for n, p in zip(languages, pools, strict=True) if p], [p for p in pools if p]
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    c = len(languages)

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)

    theta = [start(3 * hidden, 256), start(3 * hidden, hidden), start(3 * hidden, 256), start(3 * hidden, hidden), start(c, 2 * hidden), np.zeros((c, 1), np.float32)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for step in range(1, rounds + 1):
        y = rng.integers(0, c, batch)
        x = np.full((steps, batch), 32, np.uint8)
        for k, lang in enumerate(y):
            e = pools[lang][rng.integers(len(pools[lang]))]
            at = rng.integers(0, max(1, len(e) - steps + 1))
            part = e[at : at + steps]
            x[: len(part), k] = part
        f, b = Direction(*theta[:2]), Direction(*theta[2:4])
        tf: list = []
        tb: list = []
        hf, hb = _read(f, x, tf), _read(b, x[::-1], tb)[::-1]
        h = np.concatenate([hf, hb], axis=1)
        p = _softmax(np.matmul(theta[4], h) + theta[5], 1)
        p[:, y, np.arange(batch)] -= 1
        p /= steps * batch
        dout = np.einsum("tcb,thb->ch", p, h)
        dh = np.matmul(theta[4].T, p)
        gf = _learn(f, x, tf, dh[:, :hidden])
        gb = _learn(b, x[::-1], tb, dh[::-1, hidden:])
        grads = [*gf, *gb, dout, p.sum(axis=(0, 2))[:, None]]
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for k, g in enumerate(grads):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            theta[k] = theta[k] - (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, Direction(*theta[:2]), Direction(*theta[2:4]), theta[4], theta[5])


def _positions(net: Network, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Probabilities (T, languages, B) of each position of x (T, B), whose columns hold ``lens`` bytes."""
    within = None if lens.min() == len(x) else (np.arange(len(x))[:, None] < lens)[::-1].astype(net.backward.back.dtype)
    h_n = net.forward.back.shape[1]
    logits = np.matmul(net.out[:, :h_n], _read(net.forward, x)) + net.bias
    logits += np.matmul(net.out[:, h_n:], _read(net.backward, x[::-1], within=within)[::-1])
    return _softmax(logits, 1)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (rows x languages) over all bytes of each text; zero for empty ones."""
    total = np.zeros((len(texts), len(net.languages)))
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        pending.sort(key=lambda s: len(s[1]))
        for at in range(0, len(pending), SIDE_BY_SIDE):
            some = pending[at : at + SIDE_BY_SIDE]
            lens = np.array([len(s) for _, s in some])
            # blanks fill the ends of shorter segments; segments of about one length are side by side
            x = np.full((lens.max(), len(some)), 32, np.uint8)
            for k, (_, s) in enumerate(some):
                x[: len(s), k] = s
            p = _positions(net, x, lens)
            p *= (np.arange(len(x))[:, None] < lens)[:, None, :]
            np.add.at(total, [d for d, _ in some], p.sum(axis=0).T)
        pending.clear()

    for d, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(data), SEGMENT):
            pending.append((d, data[at : at + SEGMENT]))
            if len(pending) >= 4 * SIDE_BY_SIDE:
                flush()
    flush()
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def held_out(id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _excerpts(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        raw = t.encode("utf-8", "replace")
        step = max(SEGMENT, -(-len(raw) // EXCERPTS))
        out.append([raw[at : at + SEGMENT] for at in range(0, len(raw), step)])
    return pd.Series(out)


def train(docs: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, **options) -> Network | None:
    """Fit on a hash sample of the ``usable`` rows with a label: about ``rows_per_language`` of each language, of very many fewer each."""
    rows = docs.where(usable).select(col(id).cast("string").alias("i"), col(text).cast("string").alias("t"), col(lang).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().orderBy("l").collect()}
    if not counts:
        return None
    rows_per_language = max(1, min(rows_per_language, TRAIN_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * rows_per_language / n))])
    drawn = rows.where(F.pmod(F.xxhash64("i", "l"), F.lit(1_000_000)) < F.element_at(share, F.col("l")) * 1_000_000)
    drawn = drawn.limit(2 * rows_per_language * len(counts)).select("l", "i", F.pandas_udf(_excerpts, "array<binary>")("t").alias("e"))
    sample = sorted((r["l"], r["i"] or "", bytes(e)) for r in drawn.collect() for e in r["e"])
    return fit([e for _, _, e in sample], [k for k, _, _ in sample], **options)


def predicted(text: Column, net: Network | None) -> Column:
    """Struct (lang, score)."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        if net is None:
            return pd.DataFrame({"lang": [UNDETERMINED] * len(known), "score": 0.0})
        p = pooled(net, [t.encode("utf-8", "replace") if k else b"" for t, k in zip(texts, known, strict=True)])
        best = p.argmax(axis=1)
        names = [net.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        return pd.DataFrame({"lang": names, "score": np.where(known, np.round(p[np.arange(len(best)), best], 6), 0.0)})

    return predict(text.cast("string"))
