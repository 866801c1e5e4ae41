"""Document ranking: windows, representativeness, percentiles, quotas, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.config import Ranking
from corpusflow.functions import text as T
from corpusflow.operators.components import cut, stored


def window_scores(docs: DataFrame, query: list[str], c: Ranking = Ranking()) -> DataFrame:
    """(doc_id, win, n_tokens, score): BM25 of every window of ``chunk_words`` terms; a short tail goes if another window exists."""
    n, size = docs.count(), c.chunk_words
    t = docs.select("doc_id", T.tokens("text").alias("t"))
    want = F.array(*(F.lit(q) for q in sorted(set(query))))
    df = t.select(F.explode(F.array_intersect("t", want)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    win = t.where("size(t) > 0").select("doc_id", F.size("t").alias("n"), F.posexplode(F.expr(f"transform(sequence(0, cast((size(t) - 1) / {size} AS int)), i -> slice(t, i * {size} + 1, {size}))")).alias("win", "w"))
    win = win.where(f"win = 0 OR size(w) >= {size // 4}").select("doc_id", "win", F.size("w").alias("n_tokens"), F.filter("w", lambda x: F.array_contains(want, x)).alias("hit"))
    tf = win.select("doc_id", "win", "n_tokens", F.explode_outer("hit").alias("term")).groupBy("doc_id", "win", "n_tokens", "term").agg(F.count("term").alias("tf"))
    sat = F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("n_tokens") / size))
    # one row for each query term
    return tf.join(F.broadcast(idf), "term", "left").groupBy("doc_id", "win", "n_tokens").agg(F.sum(F.coalesce(F.col("idf") * sat, F.lit(0.0))).alias("score"))


def top_m(scores: DataFrame, m: int = 5) -> DataFrame:
    """(doc_id, representativeness): sum of the m best windows over m, whatever their number."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "win")
    return scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= m).groupBy("doc_id").agg((F.sum("score") / m).alias("representativeness"))


def percentile(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``pct``: average rank among equal values (at 12 decimals) over n - 1; 1 for a single row.

    Counts of equal values are combined first, so a frequent value is one row.
    Groups are cut into ranges of values, whose counts are summed up, so a
    large group is ranked by many tasks.
    """
    x = F.col(value).cast("double")
    scaled = F.round(x * 1e12, 0) / 1e12  # as DuckDB rounds: from some thousands on the last binary digit can change
    v = F.when(F.abs(x * 1e12) < F.lit(float("inf")), scaled).otherwise(x)
    each = df.groupBy(*group, v.alias("v")).agg(F.count("*").alias("c"))
    each = cut(each.repartitionByRange(*group, "v").withColumn("_r", F.spark_partition_id()))
    ranges = each.groupBy(*group, "_r").agg(F.sum("c").alias("_c"))
    whole = Window.partitionBy(*group)
    # a row for each range that a group reaches into
    below = F.sum("_c").over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_r").alias("_q"), F.coalesce(below, F.lit(0)).alias("_below"), F.sum("_c").over(whole).alias("_n"))
    same = F.col("_r") == F.col("_q")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    before = Window.partitionBy(*group, "_r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.col("_below") + F.coalesce(F.sum("c").over(before), F.lit(0))
    pct = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise((lower + (F.col("c") - 1) / 2) / (F.col("_n") - 1))
    return each.join(ranges, same).select(*group, F.col("v").alias(value), "c", pct.alias("pct"))


def apportion(sizes: DataFrame, k: int, group: str) -> DataFrame:
    """(group, size, quota): largest remainders; ties by size, then group. k is clamped to the total."""
    total = F.sum("size").over(Window.partitionBy())
    share = sizes.withColumn("_n", total).withColumn("_k", F.least(F.lit(k), F.col("_n")))
    share = share.withColumn("_e", F.col("_k") * F.col("size") / F.col("_n")).withColumn("_f", F.floor("_e"))
    order = Window.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 12)), F.desc("size"), group)
    left = F.col("_k") - F.sum("_f").over(Window.partitionBy())
    return share.withColumn("quota", (F.col("_f") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).cast("long")).select(group, "size", "quota")


def fill_quotas(ranked: DataFrame, quotas: DataFrame, group: str, order: list) -> DataFrame:
    """The first ``quota`` rows of each group in the given order."""
    w = Window.partitionBy(group).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w)).join(F.broadcast(quotas.select(group, "quota")), group).where("rank <= quota").drop("quota")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds. Edges to unknown nodes are dropped; the rank of nodes without edges is spread evenly; without edges all ranks are 1/N."""
    n = nodes.count()
    known = nodes.select("node").distinct()
    e = edges.select("src", "dst").distinct().join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    e = stored(e)
    degree = stored(e.groupBy("src").agg(F.count("*").alias("out")))
    e = stored(e.join(degree, "src").select("src", "dst", "out"))
    degree = degree.withColumnRenamed("src", "node")
    ranks = stored(known.join(degree, "node", "left").withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        got = e.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        loose = ranks.where("out IS NULL").agg(F.sum("rank")).first()[0] or 0.0  # one number
        ranks = ranks.drop("rank").join(got.withColumnRenamed("dst", "node"), "node", "left")
        # each round is used three times by the next, so its lineage is cut at once
        ranks = stored(ranks.select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank")))
    return ranks.select("node", "rank")


def final_score(df: DataFrame, c: Ranking = Ranking(), pagerank_col: str | None = None) -> DataFrame:
    """Blend of percentiles, rounded before any sort; without citations their term is left out."""
    text = (1 - c.novelty_weight) * F.col("representativeness_pct") + c.novelty_weight * F.col("novelty_pct")
    score = text if pagerank_col is None else c.alpha * text + (1 - c.alpha) * F.col(pagerank_col)
    return df.withColumn("final_score", F.round(score, 4))


def with_percentile(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Rows with the percentile of their value within their group as column ``name``; null groups are one.

    The rows are stored first: a sum computed anew for the join can differ in its
    last digit and round to another value, and its row would find no percentile.
    """
    df, x = stored(df), F.col(value).cast("double")
    v = F.when(F.abs(x * 1e12) < F.lit(float("inf")), F.round(x * 1e12, 0) / 1e12).otherwise(x)
    pct = percentile(df, group, value).select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col(value).alias("_v"), F.col("pct").alias(name))
    same = v.eqNullSafe(F.col("_v"))
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return df.join(pct, same).drop("_v", *(f"_g{k}" for k in range(len(group))))


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in the order of the given columns over the whole table.

    Ranges of the order are sorted each in its task, and what lies below a range
    is added; the table of ranges has a row for each partition.
    """
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    below = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_below"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(below), F.col("_part") == F.col("_p")).withColumn(name, (own + F.col("_below")).cast("long")).drop("_part", "_p", "_below")


def carry_forward(df: DataFrame, value: str, group: list[str], order: list, name: str) -> DataFrame:
    """Rows with the last value so far that is not null, within their group."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def final_ranking(scores: DataFrame, k: int, c: Ranking = Ranking(), pagerank: DataFrame | None = None) -> DataFrame:
    """(doc_id, cluster, final_score, place): the k best documents, dealt to clusters by their sizes.

    scores (doc_id, cluster, representativeness, novelty). Percentiles are taken
    within the cluster for representativeness and over all for novelty and rank;
    documents without a cluster are one cluster behind all others. Scores are
    rounded before they are sorted; ties go to the lower id.
    """
    s = with_percentile(scores, ["cluster"], "representativeness", "representativeness_pct")
    s = with_percentile(s.withColumn("_all", F.lit(0)), ["_all"], "novelty", "novelty_pct")
    if pagerank is not None:
        s = with_percentile(s.join(pagerank.withColumnsRenamed({"node": "doc_id", "rank": "_rank"}), "doc_id"), ["_all"], "_rank", "pagerank_pct")
    s = stored(final_score(s, c, "pagerank_pct" if pagerank is not None else None).withColumn("_c", F.coalesce(F.col("cluster").cast("string"), F.lit("￿"))))
    quotas = apportion(s.groupBy("_c").agg(F.count("*").alias("size")), k, "_c")
    best = fill_quotas(s, quotas, "_c", [F.desc("final_score"), "doc_id"])
    return positions(best.select("doc_id", "cluster", "final_score"), [F.desc("final_score"), "doc_id"], "place")
