"""Knowledge graph: names folded, triples merged, pruned and queried.

Triples are (s, p, o, doc_id): one row for each document that states one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.config import GraphFacts
from corpusflow.functions import text as T
from corpusflow.operators.components import components, maybe_in, stored


def token_triples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t_i, 'precedes', t_i+1) of neighbouring terms: a stand-in for a language model's extraction."""
    # a text's own repeats go before anything is shuffled; terms hold no blank
    pairs = F.expr("CASE WHEN size(t) > 1 THEN array_distinct(transform(sequence(0, size(t) - 2), i -> concat(t[i], ' ', t[i + 1]))) END")
    flat = docs.select("doc_id", T.tokens(text).alias("t")).select("doc_id", F.explode_outer(pairs).alias("x")).where("x IS NOT NULL")
    return flat.select(F.substring_index("x", " ", 1).alias("s"), F.lit("precedes").alias("p"), F.substring_index("x", " ", -1).alias("o"), "doc_id")


def token_mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(name, doc_id) of the ends of ``token_triples``, each once for each document: the terms of texts of two or more."""
    t = docs.select("doc_id", T.tokens(text).alias("t")).where("size(t) > 1")
    flat = t.select(F.explode(F.array_distinct("t")).alias("name"), "doc_id")
    alone = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return flat if alone else flat.distinct()


def names(triples: DataFrame) -> DataFrame:
    """(name,): each subject and object once."""
    return triples.select(F.explode(F.array("s", "o")).alias("name")).distinct()


def name_counts(triples: DataFrame) -> DataFrame:
    """(name, n): a use for each subject and each object."""
    rel = triples.select("s", "p", "o").distinct()
    return rel.select(F.col("s").alias("name")).unionByName(rel.select(F.col("o").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))


def entity_clusters(counts: DataFrame) -> DataFrame:
    """(member, rep) of groups of two names or more with one resolution key: the most used, shortest, first name stands for all."""
    # counted once: groups and members both read it
    keyed = stored(counts.withColumn("key", T.resolution_key("name")).where("key <> ''"))
    groups = keyed.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), "name")).alias("rep"), F.count("*").alias("k")).where("k > 1")
    return keyed.join(groups, "key").select(F.col("name").alias("member"), "rep")


def apply_merge(triples: DataFrame, entities: DataFrame, predicates: DataFrame | None = None) -> DataFrame:
    """Triples with names replaced by their representatives; repeated ones per document collapse."""
    m = entities.select("member", "rep")
    at = maybe_in(maybe_in(triples.select("s", "p", "o", "doc_id"), m, "member", "_s", "s"), m, "member", "_o", "o")
    # most names stand for themselves: their triples, however frequent a name is, are not shuffled to look for it
    some = at.where("_s OR _o").join(m.select(F.col("member").alias("s"), F.col("rep").alias("s2")), "s", "left").join(m.select(F.col("member").alias("o"), F.col("rep").alias("o2")), "o", "left")
    out = at.where("NOT (_s OR _o)").select("s", "p", "o", "doc_id").unionByName(some.select(F.coalesce("s2", "s").alias("s"), "p", F.coalesce("o2", "o").alias("o"), "doc_id"))
    if predicates is not None:
        out = out.join(predicates.select(F.col("member").alias("p"), F.col("rep").alias("p2")), "p", "left").select("s", F.coalesce("p2", "p").alias("p"), "o", "doc_id")
    return out.distinct()


def merge_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of what a merge did: relations, entities and predicates before and after."""

    def count(x: DataFrame, name: str) -> DataFrame:
        rel = x.select("s", "p", "o").distinct().agg(F.count("*").alias(f"relations_{name}"), F.count_distinct("p").alias(f"predicates_{name}"))
        ends = x.select(F.explode(F.array("s", "o")).alias("n")).agg(F.count_distinct("n").alias(f"entities_{name}"))
        return rel.crossJoin(ends)

    return count(before, "before").crossJoin(count(after, "after"))  # a row each


def provenance(triples: DataFrame) -> DataFrame:
    """(s, p, o, doc_ids): each triple once with the sorted documents that state it; a list is as long as its triple is frequent."""
    # dealt out first, once: sets of the documents of one task only would be larger than the rows
    return triples.repartition("s", "o").groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def fold_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """(member, rep) of two merge maps, followed to the end: a representative that was absorbed goes to its absorber's."""
    both = old.unionByName(new).select("member", "rep").distinct()
    ends = both.select("rep").distinct().join(both.where("member <> rep").select(F.col("member").alias("rep")).distinct(), "rep", "left_anti")
    roots = components(both.select(F.col("member").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    live = roots.join(ends.withColumnRenamed("rep", "node"), "node", "left_semi").groupBy("root").agg(F.min("node").alias("rep"))
    return roots.join(live, "root").select(F.col("node").alias("member"), "rep").distinct()


def dominant_definitions(votes: DataFrame, share: float = 0.8) -> DataFrame:
    """(short, long, n, share) of short forms with one long form of enough votes. votes (short, long, n) are pooled by key and shown as most often spelt."""
    pooled = votes.where(T.is_acronym("short")).withColumn("key", T.resolution_key("long")).groupBy("short", "key").agg(F.sum("n").alias("n"), F.min_by("long", F.struct(-F.col("n"), "long")).alias("long"))
    total = F.sum("n").over(Window.partitionBy("short"))
    return pooled.withColumn("share", F.col("n") / total).where(F.col("share") >= share).select("short", "long", "n", "share")


def abbreviation_clusters(triples: DataFrame, definitions: DataFrame) -> DataFrame:
    """(member, rep) where both a short form and an entity with its long form's key are nodes; of several such entities the first by name, in which entities are ordered."""
    nodes = name_counts(triples).select("name")
    long_ = nodes.select(F.col("name").alias("rep"), T.resolution_key("name").alias("key")).groupBy("key").agg(F.min("rep").alias("rep"))
    return definitions.withColumn("key", T.resolution_key("long")).join(long_, "key").join(nodes.withColumnRenamed("name", "short"), "short").where("short <> rep").select(F.col("short").alias("member"), "rep")


def prune(triples: DataFrame, ends: dict[str, tuple[str, ...]]) -> DataFrame:
    """Triples without the nodes that stand at the given ends ('s', 'o') of the given predicates."""
    gone = None
    for p, sides in ends.items():
        for side in sides:
            part = triples.where(F.col("p") == p).select(F.col(side).alias("name"))
            gone = part if gone is None else gone.unionByName(part)
    gone = gone.distinct()
    at = maybe_in(maybe_in(triples.select("s", "p", "o", "doc_id"), gone, "name", "_s", "s"), gone, "name", "_o", "o")
    # a frequent name that surely stays is not gathered in one task
    some = at.where("_s OR _o").join(gone.withColumnRenamed("name", "s"), "s", "left_anti").join(gone.withColumnRenamed("name", "o"), "o", "left_anti")
    return at.where("NOT (_s OR _o)").select("s", "p", "o", "doc_id").unionByName(some.select("s", "p", "o", "doc_id"))


def isolated(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(name,) of entities in no relation."""
    return entities.select("name").distinct().join(names(triples), "name", "left_anti")


def clean(triples: DataFrame, junk: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Without loops, blank parts, entities of the junk list (name) and those that are a document's title (title)."""
    t = triples.where("s <> o AND trim(s) <> '' AND trim(p) <> '' AND trim(o) <> ''")
    if titles is not None:
        known = titles.select(T.norm_entity("title").alias("_t")).where("_t <> ''").distinct()
        for end in ("s", "o"):
            t = t.join(known, T.norm_entity(end) == F.col("_t"), "left_anti")
    return t.join(junk.select(F.col("name").alias("s")), "s", "left_anti").join(junk.select(F.col("name").alias("o")), "o", "left_anti").select("s", "p", "o", "doc_id")


def entity_df(triples: DataFrame) -> DataFrame:
    """(name, df): documents that state a relation of the entity."""
    return mention_df(triples.select(F.explode(F.array("s", "o")).alias("name"), "doc_id").distinct())


def mention_df(mentions: DataFrame) -> DataFrame:
    """(name, df) of different (name, doc_id)."""
    return mentions.groupBy("name").agg(F.count("*").alias("df"))


def _docs_of(triples: DataFrame, names: DataFrame) -> DataFrame:
    """(name, df) of the given names only."""
    at = triples.select(F.explode(F.array("s", "o")).alias("name"), "doc_id").join(names, "name", "left_semi")
    return at.groupBy("name").agg(F.count_distinct("doc_id").alias("df"))


def graph_facts(triples: DataFrame, seeds: list[str], n_docs: int, c: GraphFacts = GraphFacts()) -> DataFrame:
    """(s, p, o, n_docs, score): relations within two hops of the seeds, the best weight that reached each times its documents.

    Seeds need enough documents, may be hubs and weigh ln(N / df). Hubs are not
    passed through; a neighbour keeps the weight of the first seed that reached
    it; each hop halves. The seeds are a query's, so their number is bounded.
    Triples are read once for each hop and once for the neighbours' documents,
    each time only where a name of the front stands; statistics of all names
    are never made.
    """
    spark = triples.sparkSession
    seeds = list(dict.fromkeys(seeds))
    at_seeds = stored(triples.where(F.col("s").isin(*seeds) | F.col("o").isin(*seeds)))
    given = spark.createDataFrame([(x, k) for k, x in enumerate(seeds)], "name string, ord int")
    s = given.join(_docs_of(at_seeds, given.select("name")), "name").where(F.col("df") >= c.min_seed_doc_freq)
    s = F.broadcast(s.select("name", "ord", F.log(F.lit(max(n_docs, 1)) / F.col("df")).alias("w")))

    def reach(rows: DataFrame, front: DataFrame) -> DataFrame:
        """Relations at either end of the front, with what reached them."""
        ends = [rows.join(front.withColumnRenamed("name", a), a).select("s", "p", "o", "doc_id", "ord", "w", F.col(b).alias("other")) for a, b in ("so", "os")]
        return ends[0].unionByName(ends[1]).groupBy("s", "p", "o", "other").agg(F.count_distinct("doc_id").alias("n_docs"), F.min_by("w", "ord").alias("w"), F.min("ord").alias("ord"), F.max("w").alias("best"))

    one = stored(reach(at_seeds, s))
    near = stored(one.where(~F.col("other").isin(*seeds)).groupBy("other").agg((F.min_by("w", "ord") * c.hop_decay).alias("w"), F.min("ord").alias("ord")).withColumnRenamed("other", "name"))
    passed = stored(near.join(_docs_of(triples, near.select("name")).where(F.col("df") <= c.hub_doc_freq), "name", "left_semi"))
    two = reach(triples, passed)
    both = one.select("s", "p", "o", "n_docs", "best").unionByName(two.select("s", "p", "o", "n_docs", "best")).where("best > 0")
    facts = both.groupBy("s", "p", "o", "n_docs").agg(F.max("best").alias("w")).select("s", "p", "o", "n_docs", (F.col("w") * F.greatest("n_docs", F.lit(1))).alias("score"))
    return facts.orderBy(F.desc(F.round("score", 9)), "s", "p", "o").limit(c.max_facts)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities (name) of a that b lacks by resolution key."""
    key = lambda d: d.select("name", T.resolution_key("name").alias("key"))
    return key(a).join(key(b).select("key").distinct(), "key", "left_anti").select("name")


def missing(a: DataFrame, b: DataFrame, threshold: float = 0.8, block: int = 2048) -> DataFrame:
    """(name, nearest, similarity) of entities of a that b has neither by name nor by a best cosine of ``threshold``.

    Both have (name, vec). The search is exact: each pair of blocks is one
    matrix product in one task. Equally near names go to the first; without
    any in b, nearest is null and the similarity -1.
    """
    a, b = (x.select("name", F.col("vec").cast("array<double>").alias("vec")).dropDuplicates(["name"]) for x in (a, b))
    left = a.join(b.select("name"), "name", "left_anti")

    def packed(x: DataFrame, k: str, v: str, n: int) -> DataFrame:
        return x.select(F.pmod(F.xxhash64("name"), F.lit(n)).alias(k), F.struct("name", "vec").alias("r")).groupBy(k).agg(F.collect_list("r").alias(v))

    na, nb = (max(1, -(-x.count() // block)) for x in (left, b))
    pairs = packed(left, "i", "x", na).crossJoin(packed(b, "j", "y", nb)).repartition(na * nb, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(rows: list) -> np.ndarray:
            v = np.array([r["vec"] for r in rows])
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y.sort(key=lambda r: r["name"])
                p, q = unit(x), unit(y)
                for lo in range(0, len(x), 256):
                    sim = p[lo : lo + 256] @ q.T
                    best = sim.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([r["name"] for r in x[lo : lo + 256]]), pa.array([y[k]["name"] for k in best]), pa.array(sim[np.arange(len(sim)), best])], ["name", "nearest", "similarity"])

    near = pairs.select("x", "y").mapInArrow(run, "name string, nearest string, similarity double")
    best = near.groupBy("name").agg(F.min_by(F.struct("nearest", "similarity"), F.struct(-F.round("similarity", 12), "nearest")).alias("z"))
    out = left.select("name").join(best, "name", "left").select("name", "z.nearest", F.coalesce("z.similarity", F.lit(-1.0)).alias("similarity"))
    return out.where(F.col("similarity") < threshold)
