"""What a user can put in place of the engine's offline parts, and those parts."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """A unit vector for each text."""


class Generator(Protocol):
    def generate(self, question: str, context: str) -> str: ...


class TripleExtractor(Protocol):
    def triples(self, docs: DataFrame) -> DataFrame:
        """(s, p, o, doc_id) of documents (doc_id, text)."""


class EntailmentScorer(Protocol):
    def entails(self, premise: Column, conclusion: Column) -> Column:
        """0 to 1."""


class TextExtractor(Protocol):
    def text(self, content: Column) -> Column: ...


class HashedTerms:
    """Counts of terms in hashed dimensions, with signs, at unit length."""

    def __init__(self, dims: int = 384) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        from corpusflow.operators.marks import terms

        out = np.zeros((len(texts), self.dims))
        for row, t in zip(out, texts, strict=True):
            for w in terms(t):
                h = xxhash.xxh64_intdigest(w)
                row[h % self.dims] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def embed_table(df: DataFrame, embedder: Embedder, text: str = "text", vec: str = "vec", batch: int = 64) -> DataFrame:
    """Rows with the vectors of their texts, embedded a batch at a time where the rows are."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        parts = [embedder.embed([x or "" for x in xs[lo : lo + batch]]) for lo in range(0, len(xs), batch)]
        return pd.Series([list(map(float, v)) for p in parts for v in p], index=xs.index)

    return df.withColumn(vec, run(text))


class Extractive:
    """Answers with the sentences of the context that share most terms with the question."""

    def __init__(self, most: int = 3) -> None:
        self.most = most

    def generate(self, question: str, context: str) -> str:
        from corpusflow.operators.chunking import sentences
        from corpusflow.operators.marks import terms

        asked = set(terms(question))
        own = [(len(asked & set(terms(s))), -k, s) for k, s in enumerate(sentences(context))]
        best = sorted((x for x in own if x[0]), reverse=True)[: self.most]
        return " ".join(s for _, _, s in sorted(best, key=lambda x: -x[1]))


class NeighbouringTerms:
    def triples(self, docs: DataFrame) -> DataFrame:
        from corpusflow.operators.kg import token_triples

        return token_triples(docs)


class TermEntailment:
    """The share of the conclusion's terms that the premise has; texts without terms entail only themselves."""

    def entails(self, premise: Column, conclusion: Column) -> Column:
        p, c = T.tokens(premise), T.tokens(conclusion)
        share = F.size(F.filter(c, lambda t: F.array_contains(p, t))) / F.size(c)
        return F.when(F.size(c) > 0, share).otherwise((premise == conclusion).cast("double"))


class PlainText:
    def text(self, content: Column) -> Column:
        return T.strip_nul(F.decode(content, "UTF-8"))


class HtmlText:
    def text(self, content: Column) -> Column:
        from corpusflow.sources.ingest import strip_tags

        return strip_tags(T.strip_nul(F.decode(content, "UTF-8")))
