"""Citation graph: references joined to the documents that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions import text as T
from corpusflow.operators.components import stored


def _one(docs: DataFrame, key: str, last: bool) -> DataFrame:
    """One document for each key: the first by ordinal, or the last."""
    best = F.max_by if last else F.min_by
    return docs.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(best("doc_id", "ord").alias("dst"))


def by_doi(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst) by equal normalised DOI; the last document wins."""
    d = _one(docs.select("doc_id", "ord", T.norm_doi("doi").alias("k")), "k", True)
    return refs.select("src", T.norm_doi("doi").alias("k")).join(d, "k").where("src <> dst").select("src", "dst").distinct()


def by_title(docs: DataFrame, refs: DataFrame, least_key: int = 4, least_contained: int = 15) -> DataFrame:
    """(src, dst) by title.

    Equal titles first (the first document wins); other references meet the
    documents that share two informative tokens (one, if either title has but
    one) and match where one title holds the other and surnames do not
    contradict. Candidates come from equal tokens, never from all pairs.
    """
    d = docs.select("doc_id", "ord", T.norm_title("title").alias("t"), F.transform(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.length(F.trim(a)) >= 4), T.surname).alias("names"), F.array_distinct(T.index_tokens("title")).alias("tok")).where(F.length("t") >= least_key)
    r = refs.select("src", "ref", T.norm_title("title").alias("rt"), F.transform(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(a) != ""), T.surname).alias("rnames"), F.array_distinct(T.index_tokens("title")).alias("rtok")).where(F.length("rt") >= least_key)
    first = _one(d, "t", False).join(d.select(F.col("doc_id").alias("dst"), "names"), "dst").withColumnRenamed("t", "rt")
    agree = (F.size("names") == 0) | (F.size("rnames") == 0) | F.arrays_overlap("names", "rnames")
    exact = r.join(first, "rt").where(agree & (F.col("src") != F.col("dst"))).select("src", "ref", "dst")
    rest = r.join(first.select("rt").distinct(), "rt", "left_anti")
    pairs = rest.select("src", "ref", "rt", "rnames", F.size("rtok").alias("rn"), F.explode("rtok").alias("tok")).join(d.select("doc_id", "ord", "t", "names", F.size("tok").alias("n"), F.explode("tok").alias("tok")), "tok")
    shared = pairs.groupBy("src", "ref", "rt", "rnames", "rn", "doc_id", "ord", "t", "names", "n").agg(F.count("*").alias("k"))
    near = shared.where((F.col("k") >= F.least(F.lit(2), "rn", "n")) & ((F.col("t").contains(F.col("rt")) & (F.length("rt") >= least_contained)) | (F.col("rt").contains(F.col("t")) & (F.length("t") >= least_contained))) & agree & (F.col("src") != F.col("doc_id")))
    w = Window.partitionBy("src", "ref").orderBy("ord")
    best = near.withColumn("r", F.row_number().over(w)).where("r = 1").select("src", "ref", F.col("doc_id").alias("dst"))
    return exact.unionByName(best).select("src", "dst").distinct()


def citation_edges(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Union of both phases: docs (doc_id, ord, title, authors, doi), refs (src, ref, title, authors, doi)."""
    return by_doi(docs, refs).unionByName(by_title(docs, refs)).distinct()


def contained_titles(docs: DataFrame, items: DataFrame, text: str = "text", broadcast_keys: int = 100_000) -> DataFrame:
    """(doc_id, item_id) of documents whose normalised text holds an item's, in words or parts of them.

    A text that holds an item holds its inner tokens, so those meet the text's,
    the rarest one of each item. The first and the last token can be parts of
    words: an item of two tokens meets the words that end with its first one, an
    item of one the words that hold it. Only different words of the corpus are
    taken apart for that. Up to ``broadcast_keys`` rows the items go to the
    texts, and texts are not shuffled; beyond, ids meet first.
    """
    t = docs.select("doc_id", T.norm_title(text).alias("t"))
    # outer: an inner one lets Spark compute the normal form once more for each token
    flat = t.select("doc_id", "t", F.explode_outer(F.array_distinct(F.split("t", " "))).alias("tok"))
    words = stored(flat.groupBy("tok").agg(F.count("*").alias("df")).where("tok <> ''"))
    i = items.select("item_id", T.norm_title("text").alias("it")).where("it <> ''").withColumn("w", F.split("it", " "))
    inner = i.where("size(w) > 2").select("item_id", F.explode(F.expr("array_distinct(slice(w, 2, size(w) - 2))")).alias("tok"))
    rare = inner.join(words, "tok").groupBy("item_id").agg(F.min_by("tok", F.struct("df", "tok")).alias("tok"))
    ends = words.select("tok", F.explode(F.expr("transform(sequence(1, length(tok)), k -> substr(tok, k))")).alias("part"))
    two = i.where("size(w) = 2").select("item_id", F.col("w")[0].alias("part")).join(ends, "part").select("item_id", "tok")
    one = i.where("size(w) = 1").select("item_id", F.col("w")[0].alias("part"))
    sizes = [r.n for r in one.select(F.length("part").alias("n")).distinct().collect()]  # lengths of words
    parts = words.select("tok", F.explode(F.expr(f"flatten(transform(array({', '.join(map(str, sizes)) or 'cast(null AS int)'}), n -> transform(sequence(1, greatest(length(tok) - n + 1, 1)), k -> substr(tok, k, n))))")).alias("part")).distinct()
    keys = rare.unionByName(two).unionByName(one.join(parts, "part").select("item_id", "tok")).distinct().join(i.select("item_id", "it").distinct(), "item_id")
    keys = stored(keys)
    if keys.count() <= broadcast_keys:
        return flat.join(F.broadcast(keys), "tok").where(F.col("t").contains(F.col("it"))).select("doc_id", "item_id").distinct()
    pairs = flat.drop("t").join(keys, "tok")
    return pairs.join(t, "doc_id").where(F.col("t").contains(F.col("it"))).select("doc_id", "item_id").distinct()
