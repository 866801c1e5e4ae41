"""Reference lists: found in a text and split into entries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusflow.functions.text import REF_HEADINGS

_HEADING = re.compile(rf"^[ \t]*(?:[\divxlc]+[.)]?\s+)?(?:{'|'.join(REF_HEADINGS)})[\s.:]*$", re.I | re.M)
_CAPTION = re.compile(r"^(?:fig(?:ure)?|table|scheme)\.?\s*\d", re.I)
_MARK = re.compile(r"^\s*(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}[.)])\s+")


def reference_section(text: str) -> str:
    """What follows the last heading of a reference list; empty without one."""
    last = None
    for last in _HEADING.finditer(text):  # noqa: B007
        pass
    return text[last.end() :].strip() if last else ""


def _starts(pattern: str, flags: int = re.M):
    rx = re.compile(pattern, flags)

    def cut(text: str) -> list[str]:
        at = [m.start() for m in rx.finditer(text)]
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=False)]

    return cut


#: In order: the first way that gives two entries or more is taken.
WAYS = (
    _starts(r"^\s*(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}[.)])\s+(?=\S)"),
    _starts(r"(?:(?<=\s)|^)\d{1,3}\.\s+(?=[A-Z])", 0),
    _starts(r"\[\d{1,3}\]\s*(?=\S)", 0),
    lambda t: re.split(r"\n\s*\n", t),
    _starts(r"^(?=[A-Z][\w'’\-]+,\s+(?:[A-Z]\.|[A-Z][a-z]+).{0,200}?\(?(?:19|20)\d\d)"),
    lambda t: t.split("\n"),
)


def split_references(text: str) -> list[str]:
    """Entries of a reference list: lines joined, markers gone, captions dropped."""
    best: list[str] = []
    for way in WAYS:
        got = [_MARK.sub("", " ".join(x.split())) for x in way(text)]
        got = [re.sub(r"^\[\d{1,3}\]\s*", "", x) for x in got if x and not _CAPTION.match(x)]
        if len(got) >= 2:
            return got
        best = best or got
    return best


def references(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ref, raw): entries of every document's reference list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, r) for d, t in zip(b["doc_id"], b[text], strict=True) for i, r in enumerate(split_references(reference_section(t or "")))]
            yield pd.DataFrame(rows, columns=["doc_id", "ref", "raw"])

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, ref int, raw string")
