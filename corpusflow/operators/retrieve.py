"""Hybrid retrieval: cosine times boost plus normalised BM25, scope, floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.config import Retrieval
from corpusflow.functions import text as T
from corpusflow.operators.lexical import bm25_squared
from corpusflow.operators.vectors import dot


def retrieve(docs: DataFrame, vectors: DataFrame, query_vector: list[float], query: list[str], scope: list[int] | None = None, boosts: DataFrame | None = None, c: Retrieval = Retrieval()) -> DataFrame:
    """The top documents of a query (doc_id, sim, boost, lex, score).

    The lexical part is divided by its maximum within the scope (1 if that is
    0). The floor applies behind the cut to the top; the best one always stays.
    """
    dims = vectors.select(F.size("embedding").alias("n")).limit(1).collect()
    if dims and dims[0].n != len(query_vector):
        raise ValueError(f"query has {len(query_vector)} dimensions, the corpus {dims[0].n}")
    q = F.array(*(F.lit(float(x)) for x in query_vector))
    d = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(bm25_squared(docs, query, c), "doc_id")
    if scope is not None:
        d = d.where(F.col("doc_id").isin(*scope))
        if d.isEmpty():
            raise ValueError(f"no indexed chunks for the requested documents: {', '.join(map(str, scope))}")
    d = d.select("doc_id", dot("embedding", q).alias("sim"), "lex")
    d = d.join(boosts, "doc_id", "left").withColumn("boost", F.coalesce("boost", F.lit(1.0))) if boosts is not None else d.withColumn("boost", F.lit(1.0))
    top = d.agg(F.max("lex").alias("m"))
    d = d.crossJoin(F.broadcast(top)).withColumn("lex", F.col("lex") / F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(1.0)))
    scored = d.select("doc_id", "sim", "boost", "lex", (F.col("sim") * F.col("boost") + c.lexical_weight * F.col("lex")).alias("score"))
    best = scored.orderBy(F.desc("score"), "doc_id").limit(c.top_k)
    return floor(best, c)


def floor(best: DataFrame, c: Retrieval = Retrieval()) -> DataFrame:
    """Of a short ranked list, the first row and those of at least the floor's share of its score."""
    w = Window.orderBy(F.desc("score"), "doc_id")
    cutoff = F.greatest(F.first("score").over(w) * c.score_floor, F.lit(0.0))
    return best.withColumn("_r", F.row_number().over(w)).withColumn("_c", cutoff).where("_r = 1 OR score >= _c").drop("_r", "_c")


def keyword_boosts(members: DataFrame, keywords: DataFrame, query: list[str], c: Retrieval = Retrieval()) -> DataFrame:
    """(doc_id, boost): 1.05 to the number of a category's keywords (category, term) that the query has, for its members."""
    hit = keywords.where(F.col("term").isin(*query)).groupBy("category").agg(F.count("*").alias("m"))
    return members.join(F.broadcast(hit), "category").groupBy("doc_id").agg(F.pow(F.lit(c.keyword_boost), F.max_by("m", "category")).alias("boost"))


def boosts(keyword: DataFrame, named: DataFrame, c: Retrieval = Retrieval()) -> DataFrame:
    """(doc_id, boost): what keywords give a document times what its name in the question does; ``named`` (doc_id) are few."""
    both = keyword.select("doc_id", "boost").unionByName(named.select("doc_id", F.lit(c.doc_boost).alias("boost")))
    return both.groupBy("doc_id").agg(F.product("boost").alias("boost"))


def facts_text(facts: DataFrame) -> DataFrame:
    """(query_id, facts): a line for each fact (query_id, place, s, p, o), without numbers."""
    line = F.concat_ws(" ", F.lit("-"), "s", "p", "o")
    return facts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "\n").alias("facts"))


def prompts(questions: DataFrame, context: DataFrame, facts: DataFrame, plain: str, with_facts: str) -> DataFrame:
    """(query_id, prompt): the template for a question (query_id, question) with its excerpts, and the other one where it has facts."""
    q = questions.join(context, "query_id", "left").join(facts, "query_id", "left")
    some = F.coalesce("facts", F.lit("")) != ""
    fill = lambda template: T.fill_template(F.lit(template), question="question", context=F.coalesce("context", F.lit("")), facts=F.coalesce("facts", F.lit("")))
    return q.select("query_id", F.when(some, fill(with_facts)).otherwise(fill(plain)).alias("prompt"))


def prompt_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered excerpts of a query's hits (query_id, rank, source, text)."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
