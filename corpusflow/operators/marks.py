"""Citation markers in replies: what each one claims, which chunk supports it, and the reply with markers put right."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.config import Grounding
from corpusflow.functions.text import STOPWORDS

#: Markers, and quotes of 25 characters or more.
MARKER = re.compile(r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]")
QUOTE = re.compile(r'["“”\']([^"“”\']{25,})["“”\']')
_LINE = re.compile(r"^[^\S\n]*>[^\S\n]?(?=\S)(.*)$", re.M)
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def terms(text: str) -> list[str]:
    return [t for t in re.findall("[a-z]+", (text or "").lower()) if len(t) > 2 and t not in STOPWORDS]


@dataclass(frozen=True)
class Mark:
    start: int
    end: int
    quoted: bool
    claim: str
    numbers: tuple[int, ...]


def quoted_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words) of quotes and of lines that begin with >."""
    return [(m.start(), m.end(), m[1]) for m in QUOTE.finditer(text)] + [(m.start(), m.end(), m[1]) for m in _LINE.finditer(text)]


def sentence_at(text: str, start: int, end: int, window: int) -> str:
    """The sentence a marker belongs to: the one that ends before it, or the one it stands in, within its line behind it."""
    parts = [p.strip() for p in _ENDS.split(text[max(0, start - window) : start])]
    before = next((p for p in reversed(parts) if p), "")
    if before.endswith((".", "!", "?")):
        return before
    line = text[end : end + window].partition("\n")[0]
    after = next((p.strip() for p in _ENDS.split(line) if p.strip()), "")
    return " ".join(x for x in (before, after) if x)


def marks(text: str, c: Grounding = Grounding()) -> list[Mark]:
    """Every marker with the nearest quote within the window, else its sentence, as its claim."""
    spans = quoted_spans(text)
    out = []
    for m in MARKER.finditer(text):
        near = [(max(m.start() - b, a - m.end(), 0), k) for k, (a, b, _) in enumerate(spans)]
        gap, k = min(near, default=(c.claim_window + 1, -1))
        quoted = gap <= c.claim_window
        claim = spans[k][2] if quoted else sentence_at(text, m.start(), m.end(), c.claim_window)
        out.append(Mark(m.start(), m.end(), quoted, claim, tuple(map(int, re.findall(r"\d+", m[0])))))
    return out


class Chunks:
    """A reply's chunks, ready to be compared with claims."""

    def __init__(self, texts: list[str], vectors: np.ndarray | None, c: Grounding) -> None:
        self.c, self.vectors = c, vectors
        own = [terms(t) for t in texts]
        self.sets, self.joined = [set(t) for t in own], ["".join(t) for t in own]

    def lexical(self, claim: str) -> tuple[int, float, bool]:
        """(chunk, score, verbatim): overlap of terms, and one more for a run of them; -1 for claims below four terms."""
        t = terms(claim)
        if len(t) < 4 or not self.sets:
            return -1, 0.0, False
        n = min(self.c.verbatim_run, len(t))
        runs = ["".join(t[i : i + n]) for i in range(len(t) - n + 1)]
        said = [any(r in j for r in runs) for j in self.joined]
        score = [v + sum(x in s for x in t) / len(t) for v, s in zip(said, self.sets, strict=True)]
        k = int(np.argmax(score))
        return (k, score[k], said[k]) if score[k] > 0 else (-1, 0.0, False)

    def support(self, m: Mark, embed: Callable[[list[str]], np.ndarray] | None) -> int:
        """The chunk that supports a marker, or -1: a quote must be verbatim, a sentence share terms or lie near."""
        k, score, verbatim = self.lexical(m.claim)
        if m.quoted:
            return k if verbatim else -1
        if k >= 0 and score >= self.c.min_overlap:
            return k
        plain = " ".join(MARKER.sub(" ", m.claim).split())
        if embed is None or self.vectors is None or len(m.claim) < 8:
            return -1
        sim = self.vectors @ embed([plain])[0]
        k = int(np.argmax(sim))
        return k if sim[k] >= self.c.similarity else -1


def repair(text: str, texts: list[str], vectors: np.ndarray | None = None, embed: Callable[[list[str]], np.ndarray] | None = None, c: Grounding = Grounding()) -> tuple[str, list[list[str]]]:
    """The reply with each marker naming the chunk that supports it, and each chunk's verified quotes.

    ``[k]`` is supported by chunk k; ``[n!]`` keeps the numbers that the reply
    gave but no chunk supports; ``[!]`` had no number in range. Blanks that this
    doubles, and those before punctuation, go.
    """
    quotes: list[list[str]] = [[] for _ in texts]
    if not texts:
        return text, quotes
    of, out, at = Chunks(texts, vectors, c), [], 0
    for m in marks(text, c):
        k = of.support(m, embed)
        known = [n for n in m.numbers if 1 <= n <= len(texts)]
        out += [text[at : m.start], f"[{k + 1}]" if k >= 0 else f"[{', '.join(map(str, known))}!]" if known else "[!]"]
        if k >= 0 and m.quoted and m.claim not in quotes[k]:
            quotes[k].append(m.claim)
        at = m.end
    whole = "".join((*out, text[at:]))
    return re.sub(r" ([.,;:)])", r"\1", re.sub(" {2,}", " ", whole)), quotes


def ground_replies(replies: DataFrame, chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None, c: Grounding = Grounding()) -> DataFrame:
    """(reply_id, reply, quotes): replies (reply_id, reply) put right against the chunks (reply_id, rank, text[, vec]) that they were given.

    A reply meets the few chunks of its prompt only; null replies stay null.
    """
    has = "vec" in chunks.columns
    given = chunks.groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", *(["vec"] if has else [])))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, reply, xs in zip(*(col.to_pylist() for col in b.columns), strict=True):
                xs = xs or []
                vec = np.array([x["vec"] for x in xs], float) if has and xs and all(x["vec"] is not None for x in xs) else None
                fixed, quotes = repair(reply, [x["text"] or "" for x in xs], vec, embed, c) if reply is not None else (None, [])
                rows.append((i, fixed, quotes))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.list_(pa.string())))], ["reply_id", "reply", "quotes"])

    return replies.join(given, "reply_id", "left").select(F.col("reply_id").cast("long"), "reply", "x").mapInArrow(run, "reply_id long, reply string, quotes array<array<string>>")


def citing_sentences(text: str) -> list[str]:
    """For every marker, in order, the sentence that it stands in; a sentence of markers alone takes the one before."""
    plain = re.sub(r"\*\*?", "", re.sub(r"`[^`]+`", " ", text or ""))
    mark = re.compile(r"\[\s*(?:\d+(?:\s*,\s*\d+)*\s*!?|!|G)\s*\]")
    out, last = [], ""
    for s in re.split(r"(?<=[.!?])\s+", plain):
        last = " ".join(mark.sub(" ", s).split()) or last
        out += [last] * len(mark.findall(s))
    return out


def nearest_spans(marks_: DataFrame, spans: DataFrame, window: int = 400) -> DataFrame:
    """(key, mark, span, gap): to each mark (key, mark, at) the nearest span (key, span, start, end) of its key within the window.

    Spans of a key do not overlap. One sort of each key's marks and spans finds
    the last span that begins before and the first one behind; of equal gaps the
    one before counts.
    """
    m = marks_.select("key", F.col("at").alias("x"), F.lit(1).alias("kind"), "mark", F.lit(None).cast("struct<start:bigint,end:bigint,span:bigint>").alias("s"))
    s = spans.select("key", F.col("start").alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("mark"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("span").cast("long").alias("span")).alias("s"))
    order = Window.partitionBy("key").orderBy("x", "kind", F.col("s.span"), "mark")
    back = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("s", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = m.withColumn("mark", F.col("mark").cast("long")).unionByName(s).withColumn("b", back).withColumn("f", ahead).where("kind = 1")
    gaps = F.array(F.struct(F.when(F.col("b").isNotNull(), F.greatest(F.col("x") - F.col("b.end"), F.lit(0))).alias("gap"), F.lit(0).alias("k"), F.col("b.span").alias("span")), F.struct((F.col("f.start") - F.col("x")).alias("gap"), F.lit(1).alias("k"), F.col("f.span").alias("span")))
    best = F.array_min(F.filter(gaps, lambda g: g["gap"].isNotNull() & (g["gap"] <= window)))
    return near.withColumn("g", best).where("g IS NOT NULL").select("key", "mark", F.col("g.span").alias("span"), F.col("g.gap").alias("gap"))
