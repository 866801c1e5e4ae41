"""What of a corpus goes to a language model, in which order, and what comes back."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions import text as T
from corpusflow.operators.rank import positions

#: Parts of headings that summarise a document.
SUMMARY_HEADINGS = ("abstract", "conclusion", "concluding remarks")


@dataclass(frozen=True)
class Selection:
    full_text: float = 0.4
    summary_chunks: float = 0.4
    summary_chars: int = 4000
    #: characters below which a body is not split any more, and how often a batch is
    min_split: int = 1500
    depth: int = 3
    temperatures: tuple[float, ...] = (0.0, 0.4, 0.7)
    #: of a model: characters a token, shares of its context for input and output, and bounds
    chars_per_token: int = 4
    input_share: float = 0.18
    output_share: float = 0.5
    fallback_context: int = 8192
    most_local_context: int = 8192
    most_output: int = 16_000
    most_chars: int = 48_000


def is_summary_heading(heading: Column | str) -> Column:
    return T.norm_heading(heading).rlike("|".join(SUMMARY_HEADINGS))


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (…, heading, body) without those of reference lists and those without a body."""
    return chunks.where(~T.is_reference_heading("heading") & (F.trim(F.coalesce("body", F.lit(""))) != ""))


def body_text(sections: Column | str, text: Column | str) -> Column:
    """Texts of the sections (heading, text) that are no reference list and not blank, a line each; the whole text if none is left."""
    s = F.col(sections) if isinstance(sections, str) else sections
    kept = F.filter(s, lambda x: ~T.is_reference_heading(x["heading"]) & (F.trim(F.coalesce(x["text"], F.lit(""))) != ""))
    return F.coalesce(F.nullif(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), F.lit("")), F.col(text) if isinstance(text, str) else text)


def split_documents(docs: DataFrame, c: Selection = Selection()) -> DataFrame:
    """(doc_id, place, full) of documents (doc_id, ordinal, rank): ranked ones first, then by ordinal; the first share goes as full text."""
    n = docs.count()
    most = max(1, math.ceil(n * c.full_text)) if n else 0
    placed = positions(docs, [F.col("rank").asc_nulls_last(), "ordinal"], "place")
    return placed.select("doc_id", "place", (F.col("place") <= most).alias("full"))


def _within(entries: DataFrame, abstract: str, c: Selection) -> DataFrame:
    """Entries (doc_id, chunk_index, heading, body) while they fit, behind the abstract; the first one always does."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    used = F.sum(F.length("body")).over(order) + F.length(F.coalesce(abstract, F.lit("")))
    first = (F.row_number().over(order) == 1) & (F.coalesce(abstract, F.lit("")) == "")
    return entries.withColumn("_used", used).withColumn("_first", first).where((F.col("_used") <= c.summary_chars) | F.col("_first")).drop("_used", "_first")


def _with_fallback(kept: DataFrame, usable: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, heading, body), with the abstract as entry -1; the first chunk of a document that has neither."""
    kept = kept.select("doc_id", "chunk_index", "heading", "body")
    said = usable.where(F.coalesce("abstract", F.lit("")) != "").groupBy("doc_id").agg(F.min("abstract").alias("body")).select("doc_id", F.lit(-1).alias("chunk_index"), F.lit("Abstract").alias("heading"), "body")
    every = kept.unionByName(said)
    first = usable.groupBy("doc_id").agg(F.min_by(F.struct("chunk_index", "heading", "body"), "chunk_index").alias("x")).select("doc_id", "x.*")
    return every.unionByName(first.join(every.select("doc_id").distinct(), "doc_id", "left_anti"))


def summary_entries(chunks: DataFrame, c: Selection = Selection()) -> DataFrame:
    """Abstract and summarising chunks of each document of chunks (doc_id, chunk_index, heading, body, abstract)."""
    usable = usable_chunks(chunks)
    norm = T.norm_heading("heading")
    has = F.coalesce("abstract", F.lit("")) != ""
    return _with_fallback(_within(usable.where(is_summary_heading("heading") & ~(has & norm.contains("abstract"))), "abstract", c), usable)


def scored_summary_entries(chunks: DataFrame, c: Selection = Selection()) -> DataFrame:
    """The best share of each document's scored chunks (…, score) in the order of the document; documents without a score by headings."""
    usable = usable_chunks(chunks)
    scored = usable.where("score IS NOT NULL")
    per = Window.partitionBy("doc_id")
    # half goes to the even number, and at least one stays
    quota = F.greatest(F.bround(F.count("*").over(per) * c.summary_chunks, 0), F.lit(1))
    best = scored.withColumn("_r", F.row_number().over(per.orderBy(F.desc("score"), "chunk_index"))).withColumn("_q", quota).where("_r <= _q").drop("_r", "_q")
    ids = scored.select("doc_id").distinct()
    rest = usable.join(ids, "doc_id", "left_anti")
    return _with_fallback(_within(best, "abstract", c), usable.join(ids, "doc_id", "left_semi")).unionByName(summary_entries(rest, c))


def call_entries(chunks: DataFrame, docs: DataFrame, c: Selection = Selection()) -> DataFrame:
    """(doc_id, place, full, chunk_index, heading, body): every chunk of full-text documents and the summaries of the others."""
    split = split_documents(docs, c)
    usable = usable_chunks(chunks)
    full = usable.join(split.where("full"), "doc_id").select("doc_id", "place", "full", "chunk_index", "heading", "body")
    rest = chunks.join(split.where("NOT full").select("doc_id"), "doc_id", "left_semi")
    short = (scored_summary_entries if "score" in chunks.columns else summary_entries)(rest, c)
    return full.unionByName(short.join(split, "doc_id").select("doc_id", "place", "full", "chunk_index", "heading", "body"))


def call_batches(entries: DataFrame, titles: DataFrame, budget: int) -> DataFrame:
    """(place, doc_id, call, text): each document's entries packed into calls under one header; full-text documents come first by place."""
    from corpusflow.operators.chunking import pack_bodies

    rows = entries.groupBy("doc_id", "place").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "heading", "body"))).alias("x")).join(titles.select("doc_id", "title"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for place, doc, title, xs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bodies = [f"{x['heading']}\n{x['body']}" if x["heading"] else x["body"] for x in xs]
                out += [(place, doc, k, call) for k, call in enumerate(pack_bodies(bodies, f"# {title or doc}\n", budget))]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["place", "doc_id", "call", "text"])

    return rows.select("place", "doc_id", "title", "x").mapInArrow(run, "place long, doc_id long, call int, text string")


def budget_chars(context: int | None, local: bool, c: Selection = Selection()) -> tuple[int, int, int]:
    """(context, characters of input, tokens of output) for a model of the given context window."""
    window = context or c.fallback_context
    if local:
        window = min(window, c.most_local_context)
    return window, min(int(window * c.input_share) * c.chars_per_token, c.most_chars), min(int(window * c.output_share), c.most_output)


def halves(bodies: list[str], c: Selection = Selection()) -> list[list[str]]:
    """Two batches of about half of the bodies; a single long body is cut at a word near its middle; else the batch itself."""
    if len(bodies) > 1:
        k = len(bodies) // 2
        return [bodies[:k], bodies[k:]]
    if bodies and len(bodies[0]) > c.min_split:
        gaps = [i for i, ch in enumerate(bodies[0]) if ch.isspace()]
        if gaps:
            at = min(gaps, key=lambda i: abs(i - len(bodies[0]) // 2))
            return [[bodies[0][:at].rstrip()], [bodies[0][at:].lstrip()]]
    return [bodies]


def generate(bodies: list[str], model: Callable[[str, float], list | None], c: Selection = Selection(), depth: int = 0) -> list | None:
    """What a model gives for a batch; where it fails the halves are tried, and what cannot be halved at higher temperatures. None if all fails."""
    first, *others = c.temperatures
    got = model("\n\n".join(bodies), first)
    if got is not None:
        return got
    parts = halves(bodies, c) if depth < c.depth else [bodies]
    if len(parts) > 1:
        found = [x for x in (generate(p, model, c, depth + 1) for p in parts) if x is not None]
        return [y for x in found for y in x] if found else None
    return next((x for x in (model("\n\n".join(bodies), t) for t in others) if x is not None), None)


def pick_sentences(sentences: DataFrame, precise: bool = False, bonus: float = 0.1, share: float = 0.6, margin: float = 0.05) -> DataFrame:
    """Of sentences (key, pos, sim, hits) those that score near the best of their key, above 0; of a key with one sentence that one."""
    per = Window.partitionBy("key")
    s = sentences.withColumn("score", F.col("sim") + bonus * F.col("hits")).withColumn("_best", F.max("score").over(per)).withColumn("_n", F.count("*").over(per))
    near = F.col("score") >= (F.col("_best") - margin if precise else F.col("_best") * share)
    return s.where((F.col("_n") == 1) | (near & (F.col("score") > 0))).drop("_best", "_n")
