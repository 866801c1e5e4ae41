"""Toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

A word's input joins a hashed word embedding and the mean of its hashed
character-trigram embeddings. Either direction's gated recurrent layer runs
over every window of ``window`` words, ``stride`` apart so that windows
overlap and cover the whole text; attention pools a window's states, and a
text's score is the calibrated score of its worst window.

Embeddings start from the smoothed log-odds of words and trigrams in the
labelled texts. Texts are labelled as a whole, so training alternates between
choosing each text's worst windows and fitting the network to them by Adam,
on the driver, over a bounded sample of whole texts (``Settings.sample`` rows
and ``sample_bytes`` of either label). A logistic curve over texts kept out of the fit calibrates the score.

Scoring is row by row without a shuffle. Null and empty texts and texts
without a word get the share of label 1 as their score; repeated rows get
the same score; an empty table gives no rows; extra columns are ignored; with
fewer than two labels every score is that share (0 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import sampled
from corpusflow.llm.quality_classifier import logistic


@dataclass(frozen=True)
class Settings:
    #: labelled rows of either label fitted on at most, and bytes of their whole texts together
    sample: int = 1500
    sample_bytes: int = 8 << 20
    word_buckets: int = 1 << 20
    char_buckets: int = 1 << 12
    dims: int = 4
    hidden: int = 6
    window: int = 16
    stride: int = 8
    rounds: int = 2
    epochs: int = 4
    batch: int = 256
    rate: float = 0.01
    embed_rate: float = 0.02
    held: float = 0.25
    threshold: float = 0.3
    seed: int = 3


@dataclass
class Model:
    s: Settings
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.0
    fitted: bool = False
    cache: dict = field(default_factory=dict)


_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_CLASS = np.array([97 <= c <= 122 or 48 <= c <= 57 or c >= 128 for c in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def tokens(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, trigram buckets, where each word's trigrams begin, and each text's number of words."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
    live = _CLASS[b]
    edge = np.flatnonzero(live[1:] != live[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    x = b.astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(live, x + np.uint64(1), np.uint64(0)) * _power(_P, len(b)))])
    h = (total[stop] - total[start]) * _power(_PINV, len(b))[start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    word = (h >> np.uint64(64 - s.word_buckets.bit_length() + 1)).astype(np.int64)
    at = np.flatnonzero(live)
    y = b.astype(np.uint32)
    tri = (y[at - 1] << np.uint32(16) | y[at] << np.uint32(8) | y[at + 1]) * np.uint32(2654435761) >> np.uint32(32 - s.char_buckets.bit_length() + 1)
    first = np.concatenate([[0], np.cumsum(stop - start)])[:-1]
    ends = np.cumsum([1 + len(r) for r in raw])
    upto = np.searchsorted(start, ends)
    return word, tri.astype(np.int32), first, np.diff(np.concatenate([[0], upto]))


def _all_tokens(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of many texts, a few at a time."""
    parts = [tokens(texts[i : i + 100], s) for i in range(0, len(texts), 100)]
    shift = np.cumsum([0, *(len(p[1]) for p in parts)])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + k for p, k in zip(parts, shift, strict=False)]), np.concatenate([p[3] for p in parts])


def windows(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window its first word, its length and its text."""
    per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - s.window) // s.stride)), 0)
    text = np.repeat(np.arange(len(counts)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    base = np.repeat(np.cumsum(counts) - counts, per)
    start = k * s.stride
    return base + start, np.minimum(s.window, counts[text] - start), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def inputs(p: dict, word: np.ndarray, tri: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(word):
        return np.zeros((0, p["word"].shape[1] + p["char"].shape[1]), np.float32)
    ends = np.concatenate([first, [len(tri)]])
    out = np.empty((len(word), p["word"].shape[1] + p["char"].shape[1]), np.float32)
    for lo in range(0, len(word), 1 << 16):
        hi = min(lo + (1 << 16), len(word))
        out[lo:hi, : p["word"].shape[1]] = p["word"][word[lo:hi]]
        out[lo:hi, p["word"].shape[1] :] = np.add.reduceat(p["char"][tri[ends[lo] : ends[hi]]], first[lo:hi] - ends[lo], 0) / np.diff(ends[lo : hi + 1]).astype(np.float32)[:, None]
    return out


def run(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows x (windows, time, inputs); with ``keep`` also what the backward pass needs."""
    n, t, _ = x.shape
    hid = p["u0"].shape[0]
    hs = np.empty((n, t, 2 * hid), np.float32)
    saved: dict = {"steps": ([], [])}
    for d in (0, 1):
        g = x @ p[f"w{d}"] + p[f"b{d}"]
        h = np.zeros((n, hid), np.float32)
        for k in range(t) if d == 0 else range(t - 1, -1, -1):
            u = h @ p[f"u{d}"]
            zr = _sigmoid(g[:, k, : 2 * hid] + u[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            c = np.tanh(g[:, k, 2 * hid :] + r * u[:, 2 * hid :])
            m = mask[:, k, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                saved["steps"][d].append((k, h, z, r, c, u[:, 2 * hid :]))
            hs[:, k, d * hid : (d + 1) * hid] = new
            h = new
    a = hs @ p["att"] + np.where(mask > 0, np.float32(0), np.float32(-1e9))
    a = np.exp(a - a.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", a, hs)
    if keep:
        saved |= {"hs": hs, "a": a, "pooled": pooled}
    return pooled @ p["out"] + p["bias"][0], saved


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the weighted log loss by the parameters and by x, and the loss."""
    logit, sv = run(p, x, mask, True)
    hid, hs, a = p["u0"].shape[0], sv["hs"], sv["a"]
    prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum())
    dl = (weight * (prob - y)).astype(np.float32)
    g = {"out": sv["pooled"].T @ dl, "bias": np.array([dl.sum()], np.float32)}
    dp = dl[:, None] * p["out"]
    da = np.einsum("nh,nth->nt", dp, hs)
    ds = a * (da - (a * da).sum(1, keepdims=True))
    dh_all = a[:, :, None] * dp[:, None, :] + ds[:, :, None] * p["att"]
    g["att"] = np.einsum("nt,nth->h", ds, hs)
    dx = np.zeros_like(x)
    for d in (0, 1):
        u = p[f"u{d}"]
        gu, gg = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * hid), np.float32)
        dh = np.zeros((len(x), hid), np.float32)
        for k, h, z, r, c, uc in reversed(sv["steps"][d]):
            dh = dh + dh_all[:, k, d * hid : (d + 1) * hid]
            m = mask[:, k, None]
            dc = dh * m * (1 - z) * (1 - c * c)
            dz = dh * m * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            gg[:, k] = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            gu += h.T @ du
            dh = dh * (1 - m * (1 - z)) + du @ u.T
        g[f"u{d}"] = gu
        g[f"w{d}"] = np.einsum("nti,ntj->ij", x, gg)
        g[f"b{d}"] = gg.sum((0, 1))
        dx += gg @ p[f"w{d}"].T
    return g, dx, loss


def start_parameters(s: Settings, rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = lambda *n, by=0.3: rng.normal(0, by, n).astype(np.float32)
    p = {"word": f(s.word_buckets, s.dims, by=0.05), "char": f(s.char_buckets, s.dims, by=0.05), "att": f(2 * s.hidden), "out": f(2 * s.hidden), "bias": np.zeros(1, np.float32)}
    for d in (0, 1):
        p |= {f"w{d}": f(2 * s.dims, 3 * s.hidden), f"u{d}": f(s.hidden, 3 * s.hidden), f"b{d}": np.zeros(3 * s.hidden, np.float32)}
    return p


def _log_odds(ids: np.ndarray, text: np.ndarray, y: np.ndarray, use: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of a bucket's occurrence in texts of label 1 against label 0, drawn towards 0 by two standard errors."""
    ends = np.searchsorted(text, np.arange(len(y) + 1))
    t, c = np.full(n, 0.5), np.full(n, 0.5)
    for k in np.flatnonzero(use):
        (t if y[k] else c)[np.unique(ids[ends[k] : ends[k + 1]])] += 1
    odds = np.log(t / (y[use].sum() + 1)) - np.log(c / ((1 - y[use]).sum() + 1))
    return (np.sign(odds) * np.clip(np.abs(odds) - 2 * np.sqrt(1 / t + 1 / c), 0, 4)).astype(np.float32)


def fit(rows: list[tuple[str, int]], share: float, s: Settings = Settings()) -> Model:
    """``share``: of label 1 among all labelled rows, which the calibrated scores follow."""
    rng = np.random.default_rng(s.seed)
    p = start_parameters(s, rng)
    model = Model(s, p, prior=share)
    y = np.array([q for _, q in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return model
    word, tri, first, counts = _all_tokens([t for t, _ in rows], s)
    doc = np.repeat(np.arange(len(rows)), counts)
    held = rng.random(len(rows)) < s.held
    chars = np.diff(np.concatenate([first, [len(tri)]]))
    p["word"][:, 0] = _log_odds(word, doc, y, ~held, s.word_buckets)
    p["char"][:, 0] = _log_odds(tri, np.repeat(doc.astype(np.int32), chars), y, ~held, s.char_buckets)
    at, length, text = windows(counts, s)
    step = np.arange(s.window)
    index = np.minimum(at[:, None] + step, max(len(word) - 1, 0)).astype(np.int32)
    mask = (step < length[:, None]).astype(np.float32)
    worst = np.where(mask > 0, p["word"][:, 0][word][index], np.float32(-9)).max(1)  # what to begin with: the window of the most telling word
    small = [n for n in p if n not in ("word", "char")]
    m1, m2, k = {n: np.zeros_like(p[n]) for n in small}, {n: np.zeros_like(p[n]) for n in small}, 0
    for turn in range(s.rounds):
        order = np.lexsort((-worst, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order], "left")
        # a text's worst window; of harmless texts also others, as all their windows are harmless
        some = order[(rank == 0) | ((y[text[order]] == 0) & ((rank == 1) | (rng.random(len(order)) < 0.05)))]
        some = some[~held[text[some]]]
        if not len(some):
            return model
        label = y[text[some]].astype(np.float32)
        weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)).astype(np.float32) * len(some)
        for _ in range(s.epochs):
            for lo in range(0, len(some), s.batch):
                pick = rng.permutation(len(some))[: s.batch]
                rows_i, msk = some[pick], mask[some[pick]]
                flat = index[rows_i].ravel()
                uniq, inv = np.unique(flat, return_inverse=True)
                spans = chars[uniq]
                t_first = np.cumsum(spans) - spans
                t_idx = np.repeat(first[uniq] - t_first, spans) + np.arange(spans.sum())
                xu = inputs(p, word[uniq], tri[t_idx], t_first)
                x = xu[inv].reshape(len(rows_i), s.window, -1)
                g, dx, _ = gradients(p, x, msk, label[pick], weight[pick] / len(pick))
                du = np.zeros_like(xu)
                np.add.at(du, inv, dx.reshape(-1, dx.shape[2]))
                k += 1
                for n, v in g.items():
                    m1[n] = 0.9 * m1[n] + 0.1 * v
                    m2[n] = 0.999 * m2[n] + 0.001 * v * v
                    p[n] -= (s.rate * (m1[n] / (1 - 0.9**k)) / (np.sqrt(m2[n] / (1 - 0.999**k)) + 1e-6)).astype(np.float32)
                # embeddings: plain steps on what the batch holds
                np.add.at(p["word"], word[uniq], -s.embed_rate * du[:, : s.dims])
                np.add.at(p["char"], tri[t_idx], np.repeat(-s.embed_rate * du[:, s.dims :] / np.maximum(spans, 1)[:, None], spans, 0))
        worst = _window_logits(p, inputs(p, word, tri, first), at, length, s)
    top = np.full(len(rows), -np.inf)
    np.maximum.at(top, text, worst)
    use = held & (counts > 0)
    if len(set(y[use].tolist())) < 2:
        use = counts > 0
    if len(set(y[use].tolist())) < 2:  # no text of the one label has a word
        return model
    model.slope, offset = logistic(top[use], y[use].astype(float))
    n1 = y[use].mean()
    model.offset = offset + math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(n1 / (1 - n1))
    model.fitted = True
    return model


def _window_logits(p: dict, x: np.ndarray, at: np.ndarray, length: np.ndarray, s: Settings) -> np.ndarray:
    out = np.empty(len(at), np.float32)
    step = np.arange(s.window)
    for lo in range(0, len(at), 2048):
        a, n = at[lo : lo + 2048], length[lo : lo + 2048]
        out[lo : lo + 2048] = run(p, x[np.minimum(a[:, None] + step, len(x) - 1)], (step < n[:, None]).astype(np.float32))[0]
    return out


def score_texts(m: Model, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), m.prior)
    if not m.fitted:
        return out
    word, tri, first, counts = tokens([t or "" for t in texts], m.s)
    at, length, text = windows(counts, m.s)
    if len(at):
        logit = _window_logits(m.p, inputs(m.p, word, tri, first), at, length, m.s).astype(float)
        has = np.flatnonzero(counts > 0)
        top = np.maximum.reduceat(logit, np.searchsorted(text, has))
        out[has] = 1 / (1 + np.exp(-np.clip(m.slope * top + m.offset, -30, 30)))
    return out


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fits on a bounded sample of either label: texts from ``docs``, (doc_id, toxic) from ``labels``."""
    n = {r.toxic: r["count"] for r in labels.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", "text").where("text <> ''")
    rows = [(r.text, q) for q in (0, 1) for r in sampled(texts, labels.where(F.col("toxic") == q), s.sample, s.sample_bytes).orderBy(F.xxhash64("doc_id")).collect()]
    total = sum(n.values())
    return fit(rows, n.get(1, 0) / total if total else 0.0, s)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row from its whole text."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                p = score_texts(m, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= m.s.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", text).mapInArrow(go, "doc_id long, score double, predicted int")
