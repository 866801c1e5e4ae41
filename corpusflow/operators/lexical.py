"""Term statistics and the two BM25 scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.config import Ranking, Retrieval
from corpusflow.functions import text as T
from corpusflow.operators.components import stored


def terms(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, term): every term of every text."""
    return docs.select(key, F.posexplode_outer(T.tokens(text)).alias("pos", "term")).where("term IS NOT NULL")


def term_freq(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return terms(docs, text, key).groupBy(key, "term").agg(F.count("*").alias("tf"))


def own_terms(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, term): each different term of each key once. A text's own repeats go where it is read; only where rows share a key is anything shuffled for it."""
    flat = docs.select(key, F.explode_outer(F.array_distinct(T.tokens(text))).alias("term")).where("term IS NOT NULL")
    alone = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return flat if alone else flat.distinct()


def doc_freq(tf: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """(term, df, idf) with idf ln((N - df + .5) / (df + .5) + 1)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def bm25_rank(docs: DataFrame, query: list[str], c: Ranking = Ranking()) -> DataFrame:
    """Ranking BM25: plain idf, true token length, average length pinned to a chunk's words. Only matched documents."""
    n = docs.count()
    t = docs.select("doc_id", T.tokens("text").alias("t"))
    want = F.array(*(F.lit(q) for q in sorted(set(query))))
    hit = t.select("doc_id", F.size("t").alias("dl"), F.explode(F.filter("t", lambda x: F.array_contains(want, x))).alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    sat = F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("dl") / c.chunk_words))
    # one row for each query term: bounded by the query
    return hit.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(idf * sat).alias("score"))


def retrieval_terms(vocabulary: DataFrame, query: list[str]) -> list[str]:
    """The query's terms that match; an unmatched plural falls back to its singular."""
    q = sorted(set(query))
    known = {r.term for r in vocabulary.where(F.col("term").isin(*q, *(x[:-1] for x in q if x.endswith("s")))).select("term").distinct().collect()}
    return sorted({x if x in known or not x.endswith("s") else x[:-1] for x in q} & known)


def bm25_squared(docs: DataFrame, query: list[str], c: Retrieval = Retrieval()) -> DataFrame:
    """Retrieval BM25: idf squared, length counts distinct terms, plural fallback. Every document, 0 without a match."""
    t = docs.select("doc_id", T.tokens("text").alias("t"))
    q = sorted({*query, *(x[:-1] for x in query if x.endswith("s"))})
    want = F.array(*(F.lit(x) for x in q))
    per = t.select("doc_id", F.size(F.array_distinct("t")).alias("dl"), F.filter("t", lambda x: F.array_contains(want, x)).alias("hit"))
    stats = per.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = per.select("doc_id", "dl", F.explode("hit").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    use = retrieval_terms(hits.select("term"), query)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    sat = F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("dl") / F.col("avgdl")))
    scored = hits.where(F.col("term").isin(*use)).join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("doc_id").agg(F.sum(F.pow(idf, 2) * sat).alias("lex"))
    return docs.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("lex", F.lit(0.0)).alias("lex"))


def novelty(docs: DataFrame) -> DataFrame:
    """Mean idf of a document's distinct terms that occur in two documents or more; 0 if none does."""
    n = docs.count()
    own = stored(own_terms(docs))
    # terms of a partition are hashed, so the documents' are not sorted
    idf = doc_freq(own, n).where("df >= 2").hint("shuffle_hash")
    got = own.join(idf, "term").groupBy("doc_id").agg(F.avg("idf").alias("novelty"))
    return docs.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce("novelty", F.lit(0.0)).alias("novelty"))


def top_terms(docs: DataFrame, k: int = 20) -> DataFrame:
    """The k terms of highest idf times df; ties in alphabetical order."""
    return doc_freq(own_terms(docs), docs.count()).select("term", (F.col("idf") * F.col("df")).alias("score")).orderBy(F.desc("score"), "term").limit(k)


def group_keywords(docs: DataFrame, group: str, k: int = 20) -> DataFrame:
    """(group, rank, term, score): terms of highest tf times idf within each group of documents."""
    n = docs.count()
    idf = doc_freq(own_terms(docs), n)
    # a group's terms are counted where its texts are read; counts of documents are never made
    scored = terms(docs, key=group).groupBy(group, "term").agg(F.count("*").alias("tf")).join(idf, "term").withColumn("score", F.col("tf") * F.col("idf"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "rank", "term", "score")
