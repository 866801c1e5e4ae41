"""Benchmark decontamination with SimHash windows. Built-in functions only.

A text's words are its runs of letters and digits in lower case, its shingles
five words long. Windows as long as a benchmark item are fingerprinted by
SimHash where they could match. The best window of all can be moved left until
its last shingle is one of the item's, and at similarity ``least`` a share of
2 * least / (100 + least) of its shingles are; so around each first shingle of
a common run, every window is opened that ends with a shingle of the item and
holds that many, beside the one aligned with the item. Fingerprints are looked up in a multi-index:
``radius + 1`` blocks, of which any fingerprint within the radius has at least
one in common with the item's. Pairs within the radius are verified by the
exact weighted similarity of their shingles, each weighing as often as it
occurs: the sum of least over the sum of greatest counts, ``least`` or more. Of
equally good windows an aligned one is named, then the first.

The benchmark is broadcast only after its shingles have been counted
(``broadcast_shingles``); a larger one is joined by shuffles. A text meets the
benchmark row by row, so copies and hot keys cost nothing more. Null and empty
texts, items below five words (they have no shingle), and items without text
match nothing; repeated rows give one result per (doc_id, item_id); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: verified similarity of a match, in hundredths
    least: int = 80
    #: bits of 64; similarity 0.8 is 9.6 bits on average, with a deviation below 3
    radius: int = 24
    broadcast_shingles: int = 2_000_000


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORDS.replace(chr(92), chr(92) * 2)}', 0)"


def _hashes(words: str, k: int) -> str:
    """SQL: hashes of the shingles of an array of words; null if there is none."""
    return f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({', '.join(f'{words}[i + {j}]' for j in range(k))})) END"


def _shingles(words: str, k: int) -> str:
    return f"transform(sequence(0, size({words}) - {k}), i -> concat_ws(' ', {', '.join(f'{words}[i + {j}]' for j in range(k))}))"


def _simhash(h: str) -> str:
    """SQL: bit b is set if it is set in over half of the hashes.

    Bits are counted four at a time, in 16-bit lanes of 16 sums; more hashes
    than a lane can count are counted bit by bit. Never null, so that Spark
    infers no filter that would compute it again.
    """
    lanes = f"transform(sequence(0, 15), b -> aggregate({h}, 0L, (c, x) -> c + (shiftrightunsigned(x, b) & 281479271743489L)))"
    fast = f"aggregate(flatten(transform({lanes}, (c, b) -> transform(sequence(0, 3), k -> CASE WHEN 2 * (shiftrightunsigned(c, 16 * k) & 65535L) > size({h}) THEN shiftleft(1L, b + 16 * k) ELSE 0L END))), 0L, (a, x) -> a | x)"
    slow = f"aggregate(sequence(0, 63), 0L, (a, b) -> a | CASE WHEN 2 * aggregate({h}, 0, (c, x) -> c + cast(shiftrightunsigned(x, b) & 1L AS int)) > size({h}) THEN shiftleft(1L, b) ELSE 0L END)"
    return f"coalesce(CASE WHEN size({h}) < 65536 THEN {fast} ELSE {slow} END, 0L)"


def _blocks(fp: str, radius: int) -> str:
    """SQL: (block, value) for radius + 1 blocks of the fingerprint."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return "array(" + ", ".join(f"struct({k} AS k, shiftrightunsigned({fp}, {lo}) & {(1 << (hi - lo)) - 1}L AS v)" for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))) + ")"


def _items(benchmark: DataFrame, s: Settings) -> DataFrame:
    return (
        benchmark.select("item_id", F.expr(_words("text")).alias("iw"))
        .withColumn("ih", F.expr(_hashes("iw", s.shingle)))
        .where("ih IS NOT NULL")
        .select("item_id", F.size("iw").alias("n"), "ih", F.expr(_simhash("ih")).alias("ifp"), F.expr(_shingles("iw", s.shingle)).alias("ish"))
    )


def windows(docs: DataFrame, items: DataFrame, s: Settings, small: bool, text: str = "text") -> DataFrame:
    """(doc_id, n, start, aligned, win): item-sized windows of words around the runs of an item's shingles."""
    anchors = items.select("item_id", "n", "ih", F.posexplode_outer("ih").alias("off", "h")).select("h", "item_id", "n", "off", F.expr("CASE WHEN off > 0 THEN ih[off - 1] END").alias("before"))
    whole = items.select("item_id", F.array_distinct("ih").alias("ih"))
    # outer: the filter that Spark infers for an inner one would compute the words anew for each shingle
    words = docs.select("doc_id", F.expr(_words(text)).alias("w"))
    seen = words.withColumn("hs", F.expr(_hashes("w", s.shingle)))
    if small:
        hits = seen.select("doc_id", "w", "hs", F.posexplode_outer("hs").alias("pos", "h")).join(F.broadcast(anchors), "h")
        begins = hits.where("before IS NULL OR pos = 0 OR hs[greatest(pos - 1, 0)] <> before")
        begins = begins.select("doc_id", "w", "hs", "pos", "off", "n", "item_id").join(F.broadcast(whole), "item_id")
    else:
        # a large benchmark: shingles are shuffled, texts meet only the places found
        flat = seen.select("doc_id", F.posexplode_outer(F.expr("transform(hs, (x, i) -> struct(x AS h, CASE WHEN i > 0 THEN hs[i - 1] END AS prev))")).alias("pos", "x")).select("doc_id", "pos", "x.*")
        found = flat.join(anchors, "h").where("before IS NULL OR prev IS NULL OR prev <> before").select("doc_id", "pos", "off", "n", "item_id").distinct()
        # a place whose text of the same id is shorter has no hash there
        begins = found.join(seen, "doc_id").where("pos < size(hs)").join(whole, "item_id")
    size = f"(n - {s.shingle - 1})"
    need = f"((2 * {s.least} * {size} + {99 + s.least}) div {100 + s.least})"
    begins = begins.select("doc_id", "n", "w", F.expr("greatest(0, least(pos - off, size(w) - n))").alias("own"), F.expr(f"cast({need} AS int)").alias("need"), F.expr(f"filter(sequence(cast(greatest(0, pos - {size} + {need}) AS int), least(size(hs) - 1, pos - off + 2 * {size} - 2)), q -> array_contains(ih, hs[q]))").alias("at"))
    # the place of the window that ends with each shingle of the item, if it holds enough of them
    ends = f"CASE WHEN size(w) >= n THEN filter(transform(at, (p, j) -> CASE WHEN j >= need - 1 AND at[greatest(j - need + 1, 0)] > p - {size} THEN greatest(0, p - {size} + 1) END), x -> x IS NOT NULL) ELSE array() END"
    starts = begins.select("doc_id", "n", "w", "own", F.explode(F.expr(f"array_union(array(own), {ends})")).alias("start"))
    return starts.select("doc_id", "n", "start", F.expr("start = own").alias("aligned"), F.expr("slice(w, start + 1, n)").alias("win"))


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, start_word, similarity) of every document that holds a benchmark item, its best window."""
    items = _items(benchmark, s)
    small = (items.agg(F.sum(F.size("ih"))).first()[0] or 0) <= s.broadcast_shingles
    near = (
        windows(docs, items, s, small, text)
        # windows are opened by each run that they hold
        .groupBy("doc_id", "n", "start", "win")
        .agg(F.max("aligned").alias("aligned"))
        .withColumn("wh", F.expr(_hashes("win", s.shingle)))
        .withColumn("fp", F.expr(_simhash("wh")))
        .withColumn("b", F.expr(_blocks("fp", s.radius)))
        .drop("wh")
        # few rows: dealt out evenly, and fingerprints are not computed again for each block
        .repartition("doc_id", "n", "start")
    )
    index = items.select("item_id", "n", "ifp", "ish", F.explode_outer(F.expr(_blocks("ifp", s.radius))).alias("x")).select("item_id", "n", "ifp", "ish", "x.*")
    index = F.broadcast(index) if small else index
    pairs = near.select("doc_id", "n", "start", "aligned", "win", "fp", "b", F.posexplode_outer("b").alias("k", "x")).select("*", "x.v").join(index, ["n", "k", "v"])
    # a pair is taken at the first block that agrees
    first = F.expr(f"NOT exists(slice({_blocks('ifp', s.radius)}, 1, k), y -> b[y.k].v = y.v)")
    pairs = pairs.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= s.radius) & first)
    common = "aggregate(array_distinct(ish), 0, (a, g) -> a + least(size(filter(ish, y -> y = g)), size(filter(wsh, y -> y = g))))"
    scored = pairs.withColumn("wsh", F.expr(_shingles("win", s.shingle))).select("doc_id", "item_id", "n", "start", "aligned", F.expr(common).alias("c"), F.expr("size(ish) + size(wsh)").alias("t"))
    # the threshold is applied to each pair's best window, behind the aggregate: Spark would move it into the join and shingle anew for each comparison
    return (
        scored.select("doc_id", "item_id", F.col("n").cast("long").alias("n_words"), F.struct(F.expr("c / (t - c)").alias("s"), "aligned", F.expr("-start").alias("p"), "c", "t").alias("best"))
        .groupBy("doc_id", "item_id", "n_words")
        .agg(F.max("best").alias("best"))
        .where(f"100 * best.c >= {s.least} * (best.t - best.c)")
        .select("doc_id", "item_id", "n_words", (-F.col("best.p")).cast("long").alias("start_word"), F.round("best.s", 6).alias("similarity"))
    )


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for ``matches`` with its default settings, without fingerprints.

    It scores every item-sized window that holds a shingle of the item, whether
    or not the operator opens it, so a better window that was missed would show.
    Of equally good ones it names the aligned ones, then those that end with a
    shingle of the item, then the first.
    """
    words = rf"regexp_extract_all(lower(coalesce(text, '')), '{WORDS}')"
    return rf"""
    WITH iw AS (SELECT item_id, {words} AS w FROM benchmark),
    i AS (SELECT item_id, len(w) AS n, o - 1 AS o, array_to_string(w[o:o + 4], ' ') AS g FROM iw, range(1, len(w) - 3) r(o)),
    d AS (SELECT doc_id, {words} AS w FROM {docs}),
    s AS (SELECT doc_id, len(w) AS m, p - 1 AS p, array_to_string(w[p:p + 4], ' ') AS g FROM d, range(1, len(w) - 3) r(p)),
    h AS (SELECT DISTINCT doc_id, m, item_id, n, p, o FROM s JOIN i USING (g)),
    al AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(p - o, m - n)) AS start FROM h),
    en AS (SELECT DISTINCT doc_id, item_id, p - n + 5 AS start FROM h),
    a AS (SELECT DISTINCT doc_id, item_id, n, start FROM (SELECT doc_id, item_id, n, unnest(range(greatest(0, least(p - n + 5, m - n)), greatest(0, least(p, m - n)) + 1)) AS start FROM h)),
    win AS (SELECT a.*, p, g FROM a JOIN s USING (doc_id) WHERE p BETWEEN start AND start + n - 5),
    wc AS (SELECT doc_id, item_id, n, start, g, count(*) AS c FROM win GROUP BY ALL),
    ic AS (SELECT item_id, g, count(*) AS c FROM i GROUP BY ALL),
    t AS (SELECT doc_id, item_id, start, sum(c) AS t FROM wc GROUP BY ALL),
    v AS (SELECT doc_id, item_id, n, start, sum(least(wc.c, ic.c)) AS c FROM wc JOIN ic USING (item_id, g) GROUP BY ALL),
    q AS (SELECT v.*, t.t + v.n - 4 AS t FROM v JOIN t USING (doc_id, item_id, start))
    SELECT doc_id, item_id, n::BIGINT AS n_words, start::BIGINT AS start_word, round(c / (t - c), 6) AS similarity
    FROM q LEFT JOIN (SELECT *, 1 AS aligned FROM al) USING (doc_id, item_id, start) LEFT JOIN (SELECT *, 1 AS ending FROM en) USING (doc_id, item_id, start)
    WHERE 100 * c >= 80 * (t - c) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c / (t - c) DESC, coalesce(aligned, 0) DESC, coalesce(ending, 0) DESC, start) = 1
    """
