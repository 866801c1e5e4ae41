"""Names in a question: documents that it names outright, and entities of the graph."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T

_KEY_DROP = re.compile(r"[\s\-_]+|[^\w]")
_FORMULA = re.compile(r"^(?=.*\d)(?:[A-Z][a-z]?\d*|[()\[\]·.+\-]|\d)+$")


def document_index(docs: DataFrame) -> DataFrame:
    """(doc_id, name, number, words, title) from (doc_id, filename, title); null where a part is too weak to name a document."""
    name = T.normalize_doc_name(F.coalesce("filename", F.lit("")))
    parts = F.split(name, " ")
    numbered = parts[0].rlike(r"^\d+(?:\.\d+)*$")
    title = F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"\s+", " "))
    share = F.length(F.regexp_replace(title, "[^a-z ]", "")) / F.length(title)
    return docs.select(
        "doc_id",
        F.when(F.length(name) >= 5, name).alias("name"),
        F.when(numbered, parts[0]).alias("number"),
        F.filter(F.when(numbered, F.slice(parts, 2, 1 << 20)).otherwise(parts), lambda w: F.length(w) > 2).alias("words"),
        F.when((F.length(title) >= 25) & (share >= 0.6), title).alias("title"),
    )


def named_documents(index: DataFrame, question: str, most: int = 2) -> DataFrame:
    """(doc_id,) of the documents a question names: by whole name, by number with one of its words, or by a long title. Over ``most`` of them it names none."""
    flat = re.sub(r"[_\s]+", " ", question.lower())
    numbers = sorted(set(re.findall(r"\d+(?:\.\d+)+|\d+", question)))
    words = sorted(set(re.findall("[a-z]+", question.lower())))
    q = F.lit(flat)
    hit = F.contains(q, F.col("name")) | F.contains(q, F.col("title")) | (F.col("number").isin(*numbers) & F.arrays_overlap("words", F.array(*(F.lit(w) for w in words)).cast("array<string>")))
    got = index.where(F.coalesce(hit, F.lit(False))).select("doc_id").limit(most + 1)
    # at most three rows
    ids = [r.doc_id for r in got.collect()]
    return index.where(F.col("doc_id").isin(*ids) if 0 < len(ids) <= most else F.lit(False)).select("doc_id")


def resolution_key(name: str) -> str:
    """The same key as ``text.resolution_key``, for strings."""
    name = name.strip()
    key = _KEY_DROP.sub("", name)
    return key if len(name) <= 4 or _FORMULA.match(name) else key.lower()


@dataclass(frozen=True)
class Span:
    entity: str
    first: int
    words: int


def candidate_spans(question: str, most: int = 6) -> list[tuple[int, int, str]]:
    """(first word, words, key) of every run of up to ``most`` words."""
    w = question.split()
    return [(i, n, k) for i in range(len(w)) for n in range(1, min(most, len(w) - i) + 1) if (k := resolution_key(" ".join(w[i : i + n])))]


def match_seeds(question: str, names: DataFrame, aliases: DataFrame | None = None, most: int = 6) -> list[Span]:
    """Entities that a question mentions: from the left, the longest run of words first, none overlapping.

    ``names`` (name), ``aliases`` (member, rep). An alias never hides an
    entity's own name, and counts only if its representative is an entity. Only
    the question's keys are looked up, so what comes back is bounded by its length.
    """
    spans = candidate_spans(question, most)
    keys = sorted({k for _, _, k in spans})
    if not keys:
        return []
    own = names.select("name", T.resolution_key("name").alias("key")).where(F.col("key").isin(*keys)).groupBy("key").agg(F.max("name").alias("name"))
    known = {r.key: r["name"] for r in own.collect()}
    if aliases is not None:
        live = aliases.join(names.select(F.col("name").alias("rep")).distinct(), "rep", "left_semi")
        more = live.select(T.resolution_key("member").alias("key"), "rep").where(F.col("key").isin(*keys)).groupBy("key").agg(F.min("rep").alias("rep"))
        known = {r.key: r.rep for r in more.collect()} | known
    out: list[Span] = []
    at = 0
    by_start: dict[int, list[tuple[int, str]]] = {}
    for i, n, k in spans:
        if k in known:
            by_start.setdefault(i, []).append((n, known[k]))
    for i in range(len(question.split())):
        if i >= at and i in by_start:
            n, name = max(by_start[i])
            out.append(Span(name, i, n))
            at = i + n
    return out


def definitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(short, long, n) of "long form (SF)" pairs: the published right-to-left match of a short form's letters in the words before it."""
    import pandas as pd

    pattern = re.compile(r"\(([A-Za-z][\w.\-]{1,9})\)")

    def expand(before: str, short: str) -> str | None:
        most = min(len(short) + 5, 2 * len(short))
        near = " ".join(before.rsplit(None, most)[-most:])
        i = len(near)
        for c in reversed([c for c in short.lower() if c.isalnum()][1:]):
            i = near.lower().rfind(c, 0, i)
            if i < 0:
                return None
        first = next(c for c in short.lower() if c.isalnum())
        while (i := near.lower().rfind(first, 0, i)) >= 0:
            if i == 0 or not near[i - 1].isalnum():
                return near[i:]
        return None

    def run(batches):
        for b in batches:
            rows = []
            for t in b[text]:
                for m in pattern.finditer(t or ""):
                    if any(c.isupper() for c in m[1]) and (long := expand(t[: m.start()], m[1])) and len(long) > len(m[1]):
                        rows.append((m[1], long))
            yield pd.DataFrame(rows, columns=["short", "long"])

    return docs.select(text).mapInPandas(run, "short string, long string").groupBy("short", "long").agg(F.count("*").alias("n"))
