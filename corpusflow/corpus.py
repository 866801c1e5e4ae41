"""A corpus as one object: tables in a folder, and what can be asked of them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import Chunking, Clustering, GraphFacts, Ranking, Retrieval
from corpusflow.functions import text as T
from corpusflow.operators import chunking, kg, lexical, marks, names, predicates, rank, retrieve, vectors
from corpusflow.operators.components import components
from corpusflow.protocols import Embedder, EntailmentScorer, Extractive, Generator, HashedTerms, NeighbouringTerms, TermEntailment, TripleExtractor, embed_table
from corpusflow.sources import records


@dataclass
class Corpus:
    """Documents (doc_id, filename, title, text, extracted_at) of a folder, and the tables made from them.

    Each stage reads the tables that it needs and replaces its own as a whole,
    so a reader sees the old or the new one. ``version`` grows with every
    replacement; what is kept in memory is dropped when it has.
    """

    spark: SparkSession
    path: str
    embedder: Embedder = field(default_factory=HashedTerms)
    extractor: TripleExtractor = field(default_factory=NeighbouringTerms)
    generator: Generator = field(default_factory=Extractive)
    entailment: EntailmentScorer = field(default_factory=TermEntailment)
    chunk: Chunking = Chunking()
    cluster: Clustering = Clustering()
    version: int = 0
    _kept: dict[str, tuple[int, DataFrame]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        held = self._kept.get(name)
        if held is None or held[0] != self.version:
            if held is not None:
                held[1].unpersist()
            held = self.version, self.spark.read.parquet(f"{self.path}/{name}").persist()
            self._kept[name] = held
        return held[1]

    def _put(self, name: str, df: DataFrame) -> None:
        records.publish(df, f"{self.path}/{name}")
        self.version += 1

    def put_documents(self, docs: DataFrame) -> None:
        """One document for each content; the least id stays."""
        d = docs.withColumn("text", T.strip_nul("text")).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
        first = d.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
        self._put("documents", d.join(first, ["sha256", "doc_id"], "left_semi").dropDuplicates(["doc_id"]))

    def embed(self) -> None:
        """Chunks of all documents with their vectors."""
        self._put("chunks", embed_table(chunking.chunks(self.table("documents"), self.chunk), self.embedder, "chunk"))

    def categorise(self, threshold: float | None = None) -> None:
        """(doc_id, cluster, keywords) from the documents' vectors."""
        t = self.cluster.threshold if threshold is None else threshold
        if not 0 < t <= 1:
            raise ValueError(f"threshold {t} is not in (0, 1]")
        docs = self.table("documents")
        v = embed_table(docs.select("doc_id", "text"), self.embedder).select(F.col("doc_id").alias("vec_id"), F.col("vec").alias("embedding"))
        near = vectors.mutual(vectors.knn(v, self.cluster.mutual_k), t)
        of = components(near.select(F.col("i").alias("a"), F.col("j").alias("b"))).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
        own = docs.select("doc_id", "text").join(of, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
        words = lexical.group_keywords(own, "cluster", self.cluster.keywords).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
        self._put("categories", own.select("doc_id", "cluster").join(words, "cluster", "left").select("doc_id", "cluster", "keywords"))

    def ranking(self, query: list[str], k: int, c: Ranking = Ranking()) -> DataFrame:
        """(doc_id, cluster, final_score, place) of the k best documents."""
        if k < 1:
            raise ValueError("k must be 1 or more")
        docs = self.table("documents")
        s = self.table("categories").select("doc_id", "cluster").join(rank.top_m(rank.window_scores(docs, query, c), c.top_m), "doc_id", "left").join(lexical.novelty(docs), "doc_id", "left")
        return rank.final_ranking(s.fillna(0.0, ["representativeness", "novelty"]), k, c)

    def build_graph(self, author_ends: dict[str, tuple[str, ...]] | None = None, junk: DataFrame | None = None) -> None:
        """Triples of all documents: cleaned, authors pruned, then entities, abbreviations and predicates merged in this order."""
        docs, none = self.table("documents"), self.spark.createDataFrame([], "name string")
        tri = kg.clean(self.extractor.triples(docs), none if junk is None else junk, docs.select("title"))
        if author_ends:
            tri = kg.prune(tri, author_ends)
        self._put("triples_raw", tri)
        tri = self.table("triples_raw")
        tri = kg.apply_merge(tri, kg.entity_clusters(kg.name_counts(tri)))
        short = kg.dominant_definitions(names.definitions(docs))
        tri = kg.apply_merge(tri, kg.abbreviation_clusters(tri, short))
        used = tri.select("p").distinct().select(F.xxhash64("p").alias("id"), F.col("p").alias("predicate"))
        self._put("triples", predicates.normalise(tri, embed_table(used, self.embedder, "predicate"), scorer=self.entailment))

    def facts(self, question: str, c: GraphFacts = GraphFacts()) -> DataFrame:
        """(s, p, o, n_docs, score) within two hops of the entities that a question mentions."""
        tri = self.table("triples")
        seeds = [x.entity for x in names.match_seeds(question, kg.name_counts(tri).select("name"), most=c.max_ngram)]
        return kg.graph_facts(tri.where("s <> o"), seeds or [""], self.table("documents").count(), c)

    def retrieve(self, question: str, doc_ids: list[int] | None = None, c: Retrieval = Retrieval()) -> DataFrame:
        """(chunk, doc_id, filename, text, sim, boost, lex, score): a question's best chunks; given documents are a hard scope, named ones a boost."""
        chunks, docs = self.table("chunks"), self.table("documents")
        if doc_ids is not None:
            chunks = chunks.where(F.col("doc_id").isin(*doc_ids))
            if chunks.isEmpty():
                raise ValueError(f"no indexed chunks for the requested documents: {', '.join(map(str, doc_ids))}")
        own = chunks.select(F.xxhash64("chunk_id").alias("id"), "doc_id", F.col("chunk").alias("text"), "vec")
        asked = list(dict.fromkeys(marks.terms(question)))
        boosts = None
        if doc_ids is None:
            named = names.named_documents(names.document_index(docs), question)
            cats = self.table("categories")
            words = cats.select(F.col("cluster").alias("category"), F.explode("keywords").alias("term")).distinct()
            both = retrieve.boosts(retrieve.keyword_boosts(cats.select("doc_id", F.col("cluster").alias("category")), words, asked, c), named, c)
            boosts = own.select("id", "doc_id").join(both, "doc_id").select(F.col("id").alias("doc_id"), "boost")
        got = retrieve.retrieve(own.select(F.col("id").alias("doc_id"), "text"), own.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding")), list(self.embedder.embed([question])[0]), asked, boosts=boosts, c=c)
        said = got.withColumnRenamed("doc_id", "id").join(own.select("id", "doc_id", "text"), "id").join(docs.select("doc_id", "filename"), "doc_id")
        return said.select(F.col("id").alias("chunk"), "doc_id", "filename", "text", *(F.round(x, 4).alias(x) for x in ("sim", "boost", "lex", "score"))).orderBy(F.desc("score"), "doc_id")

    def answer(self, question: str, doc_ids: list[int] | None = None) -> tuple[str, list]:
        """A reply with its markers verified, and the chunks it was given; at most ``top_k`` of them come to the driver."""
        hits = self.retrieve(question, doc_ids).collect()
        context = "\n\n".join(f"[{k + 1}] {h.filename}\n{h.text}" for k, h in enumerate(hits))
        reply = self.generator.generate(question, context)
        vec = self.embedder.embed([h.text for h in hits]) if hits else None
        fixed, _ = marks.repair(reply, [h.text for h in hits], vec, self.embedder.embed)
        return fixed, hits

    def full_text_count(self, share: float = 0.4) -> int:
        return max(1, math.ceil(self.table("documents").count() * share))

    def delete(self, doc_ids: list[int]) -> None:
        """Documents and all that was made from them."""
        for name in ("documents", "chunks", "categories", "triples_raw", "triples"):
            try:
                t = self.spark.read.parquet(f"{self.path}/{name}")
            except Exception as e:  # not made yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            self._put(name, t.where(~F.col("doc_id").isin(*doc_ids)))
