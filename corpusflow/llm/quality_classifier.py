"""Quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is compressed with either, block by block over its
whole length, and the difference of the two sizes over their sum, calibrated
by a logistic curve fitted on labelled rows kept out of the dictionaries, is
its score: the probability of label 1.

Fitting uses a bounded sample of whole texts on the driver (``Settings.sample``
rows and ``sample_bytes`` for each label); scoring is row by row without a shuffle. Null and
empty texts get the share of label 1 among fitted rows; repeated rows get the same
score; an empty table gives no rows; extra columns are ignored. With fewer than
two labels every score is that share (0.5 without any label).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import sampled


@dataclass(frozen=True)
class Settings:
    #: labelled rows of either label fitted on at most, and bytes of their whole texts together
    sample: int = 2000
    sample_bytes: int = 12 << 20
    dict_bytes: int = 64 << 10
    #: bytes of a piece that a dictionary is built from, and pieces of a text, spread over all of it
    piece: int = 512
    pieces: int = 8
    block: int = 1024
    level: int = 3
    #: share of the sample that is kept for the calibration
    held: float = 0.3
    threshold: float = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float
    block: int
    level: int
    threshold: float


def pieces(text: bytes, s: Settings) -> list[bytes]:
    """Pieces of a text, spread evenly from its begin to its end, so that long texts do not fill a dictionary."""
    n = -(-len(text) // s.piece)
    k = min(n, s.pieces)
    return [text[i * s.piece : (i + 1) * s.piece] for i in (j * (n - 1) // max(k - 1, 1) for j in range(k))]


def _dictionary(texts: list[bytes], s: Settings) -> bytes:
    every = [x for t in texts for x in pieces(t, s)]
    try:
        return zstandard.train_dictionary(s.dict_bytes, every).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        return b"".join(every)[-s.dict_bytes :]


class Scorer:
    def __init__(self, m: Model) -> None:
        self.m = m
        self.by = []
        for d in (m.good, m.bad):
            if d:
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=m.level)
                self.by.append(zstandard.ZstdCompressor(dict_data=z, level=m.level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, text: str) -> float:
        b = text.encode("utf-8", "replace")
        blocks = [b[i : i + self.m.block] for i in range(0, len(b), self.m.block)]
        good, bad = (sum(len(f(x)) for x in blocks) for f in self.by)
        return (bad - good) / max(1, bad + good)

    def score(self, text: str | None) -> float:
        if not text or len(self.by) < 2:
            return self.m.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.m.slope * self.difference(text) + self.m.offset))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, by Newton steps with a small penalty."""
    scale = max(float(np.abs(x).max()), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    return float(w[0] / scale), float(w[1])


def fit(good: list[str], bad: list[str], share: float, s: Settings = Settings()) -> Model:
    """``share``: of label 1 among all labelled rows, to which the calibration weighs the two samples."""
    m = Model(b"", b"", 0.0, 0.0, share, s.block, s.level, s.threshold)
    if not good or not bad:
        return m
    kept = [xs[max(1, int(len(xs) * s.held)) :] or xs for xs in (good, bad)]
    m.good, m.bad = (_dictionary([x.encode("utf-8", "replace") for x in xs], s) for xs in kept)
    held = [xs[: max(1, int(len(xs) * s.held))] for xs in (good, bad)]
    of = Scorer(m)
    x = np.array([of.difference(t) for xs in held for t in xs])
    y = np.repeat([1.0, 0.0], [len(xs) for xs in held])
    m.slope, offset = logistic(x, y)
    m.offset = offset + math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(len(held[0]) / len(held[1]))
    return m


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fits on a bounded sample of either label: texts from ``docs``, (doc_id, quality) from ``labels``."""
    n = {r.quality: r["count"] for r in labels.where("quality IN (0, 1)").groupBy("quality").count().collect()}
    texts = docs.select("doc_id", "text").where("text <> ''")
    xs = {q: [r.text for r in sampled(texts, labels.where(F.col("quality") == q), s.sample, s.sample_bytes).orderBy(F.xxhash64("doc_id")).collect()] for q in (1, 0)}
    total = sum(n.values())
    return fit(xs[1], xs[0], n.get(1, 0) / total if total else 0.5, s)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every row from its whole text; ``keep``: further columns to pass on."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", F.col(text).alias("_scored"), *keep)
    schema = ", ".join(["doc_id long", *(f"`{c}` {kind}" for c, kind in docs.select(*keep).dtypes), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(share.value)
        for batch in batches:
            p = np.array([of.score(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *batch.columns[2:], pa.array(p), pa.array((p >= of.m.threshold).astype(np.int32))], ["doc_id", *keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)
