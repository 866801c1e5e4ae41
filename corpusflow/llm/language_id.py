"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed letter n-grams
predicts each bit, and a text gets the language whose codeword has the least
exponential loss against the bits' margins. A text whose two best codewords
lie close is flagged as ambiguous. The classifiers are fitted on the driver on
a bounded sample of whole texts (``Settings.sample``), then applied to whole texts, row by
row, without any shuffle.

Null texts and texts without a letter are ``und`` with score 0; repeated rows
get the same answer; an empty table gives no rows; extra columns are ignored.
With no labelled row at all every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import sampled

LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    #: labelled rows fitted on at most, and bytes of their whole texts together
    sample: int = 2000
    sample_bytes: int = 16 << 20
    dims: int = 1 << 12
    bits: int = 15
    epochs: int = 150
    rate: float = 4.0
    penalty: float = 1e-5
    #: least lead of the best over the second probability
    margin: float = 0.2
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    scale: float
    dims: int
    margin: float


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str, dims: int) -> np.ndarray:
    """L2-normalised square roots of the counts of hashed byte 1- to 3-grams of the letters, case folded."""
    b = np.frombuffer((" " + text + " ").lower().encode("utf-8", "replace").translate(_TABLE), np.uint8).astype(np.uint32)
    live = b != 32
    pair = b[:-1] << np.uint32(8) | b[1:]
    triple = pair[:-1] << np.uint32(8) | b[2:]
    shift = np.uint32(32 - dims.bit_length() + 1)
    mix = np.uint32(2654435761)
    grams = np.concatenate([b[live] * mix >> shift, ((pair | np.uint32(1 << 24)) * mix >> shift)[live[:-1] | live[1:]], ((triple | np.uint32(1 << 25)) * mix >> shift)[live[:-2] & live[1:-1] | live[1:-1] & live[2:]]])
    x = np.sqrt(np.bincount(grams, minlength=dims).astype(np.float32))
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def codewords(n: int, bits: int, seed: int) -> np.ndarray:
    """Codewords far apart: of many random draws the one with the largest least distance, no bit constant."""
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(400):
        c = rng.choice([-1, 1], (n, bits))
        if n > 1 and (np.abs(c.sum(0)) == n).any():
            continue
        d = min(((c[i] != c[j]).sum() for i in range(n) for j in range(i)), default=bits)
        if d > far:
            best, far = c, d
    return (best if best is not None else rng.choice([-1, 1], (n, bits))).astype(np.float32)


def fit(rows: list[tuple[str, str]], s: Settings = Settings()) -> Model:
    """From (text, language) rows; one logistic classifier for each bit, all by full-batch Nesterov steps."""
    rows = [(t, lang) for t, lang in rows if t and lang and LETTER.search(t)]
    langs = sorted({lang for _, lang in rows})
    codes = codewords(len(langs), s.bits, s.seed)
    w, b = np.zeros((s.dims, s.bits), np.float32), np.zeros(s.bits, np.float32)
    if not rows:
        return Model(langs, codes, w, b, 1.0, s.dims, s.margin)
    x = np.stack([features(t, s.dims) for t, _ in rows])
    y = codes[[langs.index(lang) for _, lang in rows]]
    # rare languages weigh as much as common ones
    _, inv, n = np.unique([lang for _, lang in rows], return_inverse=True, return_counts=True)
    weigh = (len(rows) / len(n) / n[inv]).astype(np.float32)[:, None] / len(rows)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(s.epochs):
        g = -y * weigh / (1 + np.exp(np.clip(y * (x @ (w + 0.9 * vw) + b + 0.9 * vb), -30, 30)))
        vw = 0.9 * vw - s.rate * (x.T @ g + s.penalty * w)
        vb = 0.9 * vb - s.rate * g.sum(0)
        w, b = w + vw, b + vb
    return Model(langs, codes, w, b, 1.0, s.dims, s.margin)


def decode(m: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its probability and whether it leads by too little, by loss-weighted decoding."""
    if len(m.languages) < 2:
        return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
    loss = np.exp(-np.clip(margins[:, None, :] * m.codes[None], -6, 6)).sum(2)
    p = 1 / loss**2
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, 1)
    best = loss.argmin(1)
    return best, p[np.arange(len(p)), best], top[:, -1] - top[:, -2] < m.margin


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row, from its whole text."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ok = [bool(m.languages and t and LETTER.search(t)) for t in texts]
                lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if any(ok):
                    x = np.stack([features(t, m.dims) for t, good in zip(texts, ok, strict=True) if good])
                    best, p, amb = decode(m, x @ m.weights + m.bias)
                    for k, i in enumerate(i for i, good in enumerate(ok) if good):
                        lang[i], score[i], unsure[i] = m.languages[best[k]], float(p[k]), bool(amb[k])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def train(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """Fits on a bounded sample of (doc_id, text, lang) rows with a language."""
    known = labelled.where("lang IS NOT NULL")
    rows = sampled(known.select("doc_id", "text", "lang").where("text <> ''"), known, s.sample, s.sample_bytes).orderBy("doc_id").collect()
    return fit([(r.text, r.lang) for r in rows], s)
