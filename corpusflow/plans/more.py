"""Registered queries of selection, grounding, records and merging, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions import text as T
from corpusflow.operators import citations, kg, lexical, marks, names, predicates, rank, retrieve, selection, vectors
from corpusflow.operators.components import stored
from corpusflow.plans.catalogue import _DOT, _LEX, _Q, _QUOTA, _TOK, _TRI, _WIN, NEAR, QUERY_VECTOR, QUESTION, TERMS, _clusters, _list, query, t
from corpusflow.sources import ingest, records

_NT = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query("SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:30].array_to_string(' ') AS words FROM documents")
def norm_words(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(F.slice(T.norm_words("text"), 1, 30), " ").alias("words"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3), lambda w: CASE WHEN w LIKE '%s' THEN w[:-2] ELSE w END))), ' ') AS tokens FROM benchmark WHERE regexp_full_match(text, '[\\x00-\\x7f]*')")
def keyword_tokens(spark, d):
    return t(spark, d, "benchmark").where(~F.col("text").rlike(r"[^\x00-\x7f]")).select("item_id", F.array_join(F.array_sort(T.keyword_tokens("text")), " ").alias("tokens"))


_SPLIT = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z0-9(\"\\x27\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) >= 25)"


@query(
    f"WITH s AS (SELECT item_id AS key, unnest({_SPLIT}) AS s, generate_subscripts({_SPLIT}, 1) - 1 AS pos FROM benchmark), h AS (SELECT key, pos, length(s) / 1000 AS sim, len(list_intersect(list_distinct({_TOK.format('s')}), [{_list(QUESTION)}])) AS hits FROM s), x AS (SELECT key, pos, sim + 0.1 * hits AS score FROM h) "
    "SELECT key, pos::BIGINT AS pos, round(score, 6) AS score FROM x QUALIFY count(*) OVER (PARTITION BY key) = 1 OR (score >= max(score) OVER (PARTITION BY key) * 0.6 AND score > 0)"
)
def sentence_pick(spark, d):
    s = t(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.posexplode(T.viewer_sentences("text")).alias("pos", "s"))
    hits = F.size(F.array_intersect(T.tokens("s"), F.array(*map(F.lit, QUESTION))))
    got = selection.pick_sentences(s.select("key", "pos", (F.length("s") / 1000).alias("sim"), hits.alias("hits")))
    return got.select("key", F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


@query("SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_other FROM events")
def carry_forward(spark, d):
    e = t(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "click", F.col("event_type")))
    return rank.carry_forward(e, "v", ["user_id"], ["ts", "event_id"], "last_other").select("event_id", "last_other")


@query(
    "WITH m AS (SELECT user_id AS key, event_id AS mark, floor(epoch(ts))::BIGINT AS x FROM events WHERE event_type = (SELECT min(event_type) FROM events)), s AS (SELECT user_id AS key, event_id AS span, floor(epoch(ts))::BIGINT AS a FROM events WHERE event_type = (SELECT max(event_type) FROM events)), "
    "p AS (SELECT m.key, mark, span, abs(x - a) AS gap, (a > x)::INT AS k FROM m JOIN s ON m.key = s.key AND abs(x - a) <= 100000) SELECT key, mark, gap FROM p QUALIFY row_number() OVER (PARTITION BY key, mark ORDER BY gap, k, span) = 1"
)
def nearest_span(spark, d):
    e = t(spark, d, "events").withColumn("x", F.unix_timestamp("ts"))
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    m = e.where(F.col("event_type") == ends.lo).select(F.col("user_id").alias("key"), F.col("event_id").alias("mark"), F.col("x").alias("at"))
    s = e.where(F.col("event_type") == ends.hi).select(F.col("user_id").alias("key"), F.col("event_id").alias("span"), F.col("x").alias("start"), F.col("x").alias("end"))
    return marks.nearest_spans(m, s, 100_000).select("key", "mark", "gap")


@query("WITH c AS (SELECT label AS cluster, count(*) AS size, min(vec_id) AS first FROM embeddings GROUP BY label) SELECT cluster, size, row_number() OVER (ORDER BY size DESC, first) AS place FROM c")
def cluster_order(spark, d):
    c = t(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"), F.min("vec_id").alias("first"))
    return rank.positions(c, [F.desc("size"), "first"], "place").select("cluster", "size", "place")


@query("SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN doc_id % 101 END ASC NULLS LAST, doc_id) AS place, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN doc_id % 101 END ASC NULLS LAST, doc_id) <= greatest(1, ceil(0.4 * count(*) OVER ())) AS full FROM documents")
def split_documents(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 101).alias("rank"))
    return selection.split_documents(docs)


_CH = "ch AS (SELECT doc_id, i - 1 AS chunk_index, CASE i % 5 WHEN 1 THEN 'Abstract' WHEN 2 THEN '3. Conclusions' WHEN 3 THEN 'References' ELSE 'Methods' END AS heading, trim(l) AS body, CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, 90) END AS abstract, CASE WHEN doc_id % 2 = 0 THEN (length(l) * 7919) % 1009 END AS score FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE true), us AS (SELECT * FROM ch WHERE heading <> 'References' AND body <> '')"


def _chunks(spark, d):
    """Lines of documents as chunks under headings by turns, some with an abstract, some with a score."""
    lines = t(spark, d, "documents").select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("chunk_index", "l"))
    turn = (F.col("chunk_index") + 1) % 5
    heading = F.when(turn == 1, "Abstract").when(turn == 2, "3. Conclusions").when(turn == 3, "References").otherwise("Methods")
    return lines.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), heading.alias("heading"), F.trim("l").alias("body"), F.when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 90)).alias("abstract"), F.when(F.col("doc_id") % 2 == 0, (F.length("l").cast("long") * 7919) % 1009).alias("score"))


_REST = "a AS (SELECT DISTINCT doc_id, -1 AS chunk_index, 'Abstract' AS heading, abstract AS body FROM us WHERE coalesce(abstract, '') <> ''), k AS (SELECT doc_id, chunk_index, heading, body FROM w WHERE used <= 4000 OR (r = 1 AND coalesce(abstract, '') = '') UNION ALL SELECT * FROM a), f AS (SELECT doc_id, arg_min({'c': chunk_index, 'h': heading, 'b': body}, chunk_index) AS x FROM us GROUP BY doc_id), e AS (SELECT * FROM k UNION ALL SELECT doc_id, x.c, x.h, x.b FROM f WHERE doc_id NOT IN (SELECT doc_id FROM k)) SELECT doc_id, chunk_index::BIGINT AS chunk_index, heading, md5(body) AS body FROM e"
_USED = "row_number() OVER o AS r, sum(length(body)) OVER o + length(coalesce(abstract, '')) AS used"


@query(f"WITH {_CH}, w AS (SELECT *, {_USED} FROM us WHERE heading IN ('Abstract', '3. Conclusions') AND NOT (coalesce(abstract, '') <> '' AND heading = 'Abstract') WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)), {_REST}")
def summary_entries(spark, d):
    return selection.summary_entries(_chunks(spark, d)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "heading", F.md5("body").alias("body"))


@query(f"WITH {_CH.replace('documents) WHERE true', 'documents WHERE doc_id % 2 = 0) WHERE true')}, b AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) <= greatest(1, round_even(count(*) OVER (PARTITION BY doc_id) * 0.4, 0))), w AS (SELECT *, {_USED} FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)), {_REST}")
def scored_summary(spark, d):
    return selection.scored_summary_entries(_chunks(spark, d).where("doc_id % 2 = 0")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "heading", F.md5("body").alias("body"))


@query()
def call_batches(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 101).alias("rank"))
    entries = selection.call_entries(_chunks(spark, d).drop("score"), docs)
    return selection.call_batches(entries, docs.select("doc_id", F.lit(None).cast("string").alias("title")), 6000).select("place", "doc_id", "call", F.length("text").alias("n_chars"))


@query("SELECT doc_id, n AS n_kept, b AS n_dropped, n = 0 AS failed, CASE WHEN n > 0 THEN doc_id || ' s0' END AS first FROM (SELECT doc_id, doc_id % 5 AS n, doc_id % 3 AS b FROM documents)")
def tolerant_parse(spark, d):
    """Model replies made of good and bad elements, in fences, some cut off."""
    x = t(spark, d, "documents").select("doc_id", F.expr("cast(doc_id % 5 AS int)").alias("n"), F.expr("cast(doc_id % 3 AS int)").alias("b"))
    good = F.expr("""CASE WHEN n > 0 THEN transform(sequence(0, n - 1), k -> CASE WHEN k % 2 = 0 THEN concat('["', doc_id, ' s', k, '", "uses [", "o"]') ELSE concat('{"subject": "', doc_id, ' s', k, '", "predicate": "p", "object": "o"}') END) ELSE array() END""")
    bad = F.expr("""CASE WHEN b > 0 THEN transform(sequence(0, b - 1), k -> CASE WHEN k = 0 THEN '["a", ["b"], "c"]' ELSE '["a", "", "c"]' END) ELSE array() END""")
    said = F.concat(F.lit("Here it is:\n```json\n["), F.array_join(F.concat(good, bad), ",\n"), F.when(F.col("doc_id") % 2 == 0, ']\n```').otherwise(', ["cut of'))
    got = x.select("doc_id", "n", "b", T.parse_triples(said).alias("r"))
    # the inner list of a bad element is what closes first
    return got.select("doc_id", F.size("r.kept").cast("long").alias("n_kept"), F.col("r.dropped").cast("long").alias("n_dropped"), F.col("r.failed").alias("failed"), F.get("r.kept", F.lit(0))["s"].alias("first"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT.format('a.embedding', 'b.embedding')}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND (a.vec_id % 7 = 0) = (b.vec_id % 7 = 0) WHERE {_DOT.format('a.embedding', 'b.embedding')} >= {NEAR}")
def predicate_pairs(spark, d):
    p = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("is made by "), "vec_id", F.lit(" by"))).otherwise(F.concat(F.lit("makes "), "vec_id")).alias("predicate"), F.col("embedding").alias("vec"))
    return predicates.candidate_pairs(p, NEAR).select("a", "b", F.round("sim", 6).alias("sim"))


@query("WITH w AS (SELECT item_id, list_filter(string_split(" + _NT.format("text") + ", ' '), lambda x: x <> '') AS w FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, a.w AS x, b.w AS y FROM w a JOIN w b ON b.item_id = a.item_id + 1), u AS (SELECT a, b, unnest(x) AS t, 1 AS l, 0 AS r FROM p UNION ALL SELECT a, b, unnest(y), 0, 1 FROM p), c AS (SELECT a, b, t, sum(l) AS l, sum(r) AS r FROM u GROUP BY ALL) SELECT a, b, round(sum(l * r) / sqrt(sum(l * l) * sum(r * r)), 6) AS sim FROM c GROUP BY a, b")
def title_cosines(spark, d):
    i = t(spark, d, "benchmark")
    pairs = i.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(i.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("y")), "a")
    return pairs.select("a", "b", F.round(T.title_cosine("x", "y"), 6).alias("sim"))


@query("SELECT DISTINCT s_suppkey AS src, arg_max(p_partkey, p_partkey) OVER (PARTITION BY p_partkey % 50) AS dst FROM supplier JOIN part ON p_partkey % 50 = s_suppkey % 60 QUALIFY src <> dst")
def citation_by_doi(spark, d):
    docs = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("https://doi.org/10.1000/X"), F.col("p_partkey") % 50, F.lit(".")).alias("doi"))
    refs = t(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.concat(F.lit("DOI: 10.1000/x"), F.col("s_suppkey") % 60).alias("doi"))
    return citations.by_doi(docs, refs)


@query("WITH p AS (SELECT min(p_partkey) AS dst, " + _NT.format("p_name") + " AS k FROM part GROUP BY k) SELECT DISTINCT p_partkey + 1000000 AS src, dst FROM part JOIN p ON k = " + _NT.format("p_name") + " WHERE length(k) >= 4 AND p_partkey % 3 = 0")
def citation_by_title(spark, d):
    docs = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.array().cast("array<string>").alias("authors"))
    refs = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("src"), F.lit(0).alias("ref"), F.upper("title").alias("title"), "authors")
    return citations.by_title(docs, refs)


_JUNK = ["the", "thing", "ander", "ingre", "tions"]


@query(f"WITH {_TRI} SELECT s, p, o, count(*) AS n_docs FROM tri WHERE s <> o AND s NOT IN ({_list(_JUNK)}) AND o NOT IN ({_list(_JUNK)}) GROUP BY s, p, o")
def junk_filter(spark, d):
    junk = spark.createDataFrame([(x,) for x in _JUNK], "name string")
    return kg.clean(kg.token_triples(t(spark, d, "documents")), junk).groupBy("s", "p", "o").agg(F.count("*").alias("n_docs"))


@query("SELECT o_orderkey AS doc_id FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS newest FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE newest IS NULL OR newest < o_orderdate + INTERVAL 60 DAY")
def stale_documents(spark, d):
    docs = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("cast(o_orderdate + INTERVAL 60 DAY AS timestamp)").alias("extracted_at"))
    return ingest.stale(docs, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_shipdate").cast("timestamp").alias("ingested_at")))


@query("SELECT user_id AS doc_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status FROM events GROUP BY user_id")
def status_latest(spark, d):
    return ingest.status_now(t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("at")))


@query("SELECT doc_id, CASE WHEN trim(coalesce(lang, '')) <> '' AND doc_id % 2 = 0 THEN lang WHEN trim(coalesce(source, '')) <> '' AND doc_id % 3 = 0 THEN source WHEN trim(coalesce(text, '')) <> '' THEN substr(text, 1, 20) END AS title FROM documents WHERE substr(text, 1, 20) IS NULL OR trim(substr(text, 1, 20)) <> ''")
def fallback_merge(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("a"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit("  ")).alias("b"), F.substring("text", 1, 20).alias("c"))
    return records.fallback(x.where("c IS NULL OR trim(c) <> ''"), {"title": ["a", "b", "c"]}).select("doc_id", "title")


@query("SELECT vec_id AS doc_id, CASE WHEN label % 2 = 0 THEN 'k' || label || ', l' || label || ', m' || label ELSE 'cluster ' || label END AS category FROM embeddings")
def label_writeback(spark, d):
    v = t(spark, d, "embeddings")
    word = lambda c: F.concat(F.lit(c), F.col("label"))
    cats = v.groupBy(F.col("label").alias("cluster")).agg(F.collect_list("vec_id").alias("doc_ids")).withColumn("label", F.col("cluster"))
    cats = cats.withColumn("keywords", F.when(F.col("label") % 2 == 0, F.array(word("k"), word("l"), word("m"), word("n"))).otherwise(F.array().cast("array<string>")))
    return records.labels(v.select(F.col("vec_id").alias("doc_id")), cats).select("doc_id", "category")


_NAMED = "what do doc 17 and thing ingre ander heres onons tions thble say"
_BOOST = "CASE WHEN contains('" + _NAMED + "', 'doc ' || doc_id) AND length('doc ' || doc_id) >= 5 THEN 2.0 ELSE 1.0 END * CASE WHEN label = 0 THEN 1.05 * 1.05 WHEN label = 1 THEN 1.05 ELSE 1.0 END"


@query(
    f"WITH {_LEX}, s AS (SELECT doc_id, {_DOT.format('embedding', _Q)} AS sim, lex, ({_BOOST})::DOUBLE AS boost FROM lexed JOIN embeddings ON vec_id = doc_id), k AS (SELECT doc_id, sim, boost, lex / coalesce(nullif((SELECT max(lex) FROM s), 0), 1) AS lex FROM s), r AS (SELECT *, sim * boost + 0.3 * lex AS score FROM k ORDER BY score DESC, doc_id LIMIT 8) "
    "SELECT doc_id, round(sim, 6) AS sim, round(boost, 6) AS boost, round(lex, 6) AS lex, round(score, 6) AS score FROM r WHERE score >= greatest(0.5 * (SELECT max(score) FROM r), 0) OR score = (SELECT max(score) FROM r)"
)
def hybrid_retrieve_boosted(spark, d):
    """Named documents and keywords of categories raise a document's similarity."""
    docs, v = t(spark, d, "documents"), t(spark, d, "embeddings")
    files = docs.select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("filename"), F.lit(None).cast("string").alias("title"))
    named = names.named_documents(names.document_index(files), _NAMED)
    words = spark.createDataFrame([(0, "thing"), (0, "ingre"), (0, "absent"), (1, "ander")], "category int, term string")
    members = v.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("category"))
    boosts = retrieve.boosts(retrieve.keyword_boosts(members, words, QUESTION), named)
    q = list(v.where(F.col("vec_id") == QUERY_VECTOR).first().embedding)
    got = retrieve.retrieve(docs, v, q, QUESTION, boosts=boosts)
    return got.select("doc_id", *(F.round(c, 6).alias(c) for c in ("sim", "boost", "lex", "score")))


_RANK = (
    f"WITH {_WIN}, rp AS (SELECT doc_id, sum(score) / 5 AS r FROM (SELECT * FROM ws QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, win) <= 5) GROUP BY doc_id), nv AS (SELECT doc_id, avg(idf) AS v FROM tf JOIN idf USING (term) WHERE df >= 2 GROUP BY doc_id), "
    "b AS (SELECT vec_id AS doc_id, label AS cluster, round(coalesce(r, 0), 12) AS r, round(coalesce(v, 0), 12) AS v FROM embeddings JOIN documents ON doc_id = vec_id LEFT JOIN rp USING (doc_id) LEFT JOIN nv USING (doc_id)), "
    "q AS (SELECT *, CASE WHEN count(*) OVER c = 1 THEN 1 ELSE (rank() OVER (PARTITION BY cluster ORDER BY r) - 1 + (count(*) OVER (PARTITION BY cluster, r) - 1) / 2) / (count(*) OVER c - 1) END AS rpct, (rank() OVER (ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2) / (count(*) OVER () - 1) AS vpct FROM b WINDOW c AS (PARTITION BY cluster)), "
    "z AS (SELECT doc_id, cluster, round(0.8 * rpct + 0.2 * vpct, 4) AS final_score FROM q), " + _QUOTA.replace("37", "50").replace("label AS", "cluster AS").replace("FROM embeddings GROUP BY label", "FROM z GROUP BY cluster").replace("SELECT label, count(*)", "SELECT cluster AS label, count(*)") + ", "
    "y AS (SELECT z.* FROM z JOIN quota ON label = cluster QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY final_score DESC, doc_id) <= any_value(quota) OVER (PARTITION BY cluster)) SELECT doc_id, cluster, final_score, row_number() OVER (ORDER BY final_score DESC, doc_id) AS place FROM y"
)


@query(_RANK)
def final_ranking(spark, d):
    docs, v = t(spark, d, "documents"), t(spark, d, "embeddings")
    r = rank.top_m(rank.window_scores(docs, QUESTION))
    n = lexical.novelty(docs)
    base = v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster")).join(docs.select("doc_id"), "doc_id")
    s = base.join(r, "doc_id", "left").join(n, "doc_id", "left").fillna(0.0, ["representativeness", "novelty"])
    return rank.final_ranking(s, 50).select("doc_id", "cluster", "final_score", "place")


_SAID = "coalesce(text, '') || ' [1, ' || (turn + 1) || '] x [G] [' || turn || '!] [KG]'"


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct([1, turn + 1])), ',') AS cited, turn::VARCHAR AS flagged, length(replace(replace({_SAID}, '[KG]', '[G]'), '[G]', CASE WHEN turn % 2 = 0 THEN '' ELSE '[G]' END)) AS n FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '[\\[\\]]')")
def reply_markers(spark, d):
    c = t(spark, d, "conversations").where(~F.coalesce("text", F.lit("")).rlike(r"[\[\]]"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" [1, "), (F.col("turn") + 1).cast("string"), F.lit("] x [G] ["), F.col("turn").cast("string"), F.lit("!] [KG]"))
    return c.select("conv_id", "turn", F.array_join(T.cited_numbers(said), ",").alias("cited"), F.array_join(T.cited_numbers(said, True), ",").alias("flagged"), F.length(T.graph_markers(said, F.col("turn") % 2)).cast("long").alias("n"))


@query("SELECT item_id, '# ' || item_id || chr(10) || text || chr(10) || '{other}' AS prompt FROM benchmark")
def template_fill(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.fill_template(F.lit("# {id}\n{text}\n{other}"), id="item_id", text="text").alias("prompt"))


@query(f"WITH w AS (SELECT item_id, {_TOK.format('text')} AS c FROM benchmark), x AS (SELECT doc_id, {_TOK.format('text')} AS k FROM documents), tt AS (SELECT DISTINCT doc_id, unnest(k) AS t FROM x), cc AS (SELECT item_id, unnest(c) AS t, len(c) AS n FROM w WHERE len(c) >= 4), o AS (SELECT item_id, doc_id, count(*) / any_value(n) AS overlap FROM cc JOIN tt USING (t) GROUP BY ALL) SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.5")
def claim_sources(spark, d):
    """Claims, here the items, and the documents that hold at least half of their terms."""
    from corpusflow.operators import grounding

    claims = t(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    got = grounding.sources(claims, t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk")))
    return got.select(F.col("claim_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("overlap", 6).alias("overlap"))


@query()
def ground_reply(spark, d):
    """Turns as replies, each against the turns before it in its conversation."""
    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("reply_id"), "conv_id", "turn", "text")
    replies = c.where("turn > 0").select("reply_id", F.concat("text", F.lit(" [1]. Also, it is so [7].")).alias("reply"), "conv_id", "turn")
    near = replies.select("reply_id", "conv_id", F.explode(F.expr("sequence(greatest(turn - 8, 0), turn - 1)")).alias("turn"))
    chunks = near.join(c.drop("reply_id"), ["conv_id", "turn"]).select("reply_id", F.col("turn").alias("rank"), "text")
    return marks.ground_replies(replies.select("reply_id", "reply"), chunks).select("reply_id", "reply", F.size(F.flatten("quotes")).alias("n_quotes"))


@query("SELECT lang, count(*) AS n_docs, min(doc_id) AS first FROM documents GROUP BY lang")
def distinct_ordered(spark, d):
    docs = t(spark, d, "documents")
    n = docs.groupBy("lang").agg(F.count("*").alias("n_docs"))
    return n.join(records.distinct_in_order(docs, "lang", "doc_id").withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "n_docs", F.col("doc_id").alias("first"))


@query(f"WITH {_TRI}, c AS (SELECT s, p, o, doc_id FROM tri WHERE s < o), m AS (SELECT DISTINCT CASE WHEN s LIKE 'th%' THEN substr(s, 3) ELSE s END AS s, p, CASE WHEN o LIKE 'th%' THEN substr(o, 3) ELSE o END AS o, doc_id FROM c) SELECT (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM c)) AS relations_before, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM m)) AS relations_after, (SELECT count(*) FROM (SELECT s FROM c UNION SELECT o FROM c)) AS entities_before, (SELECT count(*) FROM (SELECT s FROM m UNION SELECT o FROM m)) AS entities_after, 1::BIGINT AS predicates_before, 1::BIGINT AS predicates_after")
def merge_counters(spark, d):
    tri = stored(kg.token_triples(t(spark, d, "documents")).where("s < o"))
    m = kg.names(tri).where("name LIKE 'th%'").select(F.col("name").alias("member"), F.expr("substr(name, 3)").alias("rep"))
    return kg.merge_stats(tri, kg.apply_merge(tri, m))


_PX = "px AS (SELECT l_returnflag || l_linestatus AS page, (l_partkey * 7 + l_suppkey) % 256 AS value FROM lineitem), hi AS (SELECT page, value, count(*) AS n FROM px GROUP BY ALL)"


def _pixels(spark, d):
    return t(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("page"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 256).alias("value"))


@query(f"WITH {_PX}, c AS (SELECT page, value, sum(n) OVER u AS w, sum(n * value) OVER u AS m, sum(n) OVER p AS nn, sum(n * value) OVER p AS mm FROM hi WINDOW p AS (PARTITION BY page), u AS (PARTITION BY page ORDER BY value)), b AS (SELECT page, value, CASE WHEN w < nn THEN round(pow(mm::DOUBLE * w / nn - m, 2) / (w::DOUBLE * (nn - w)), 9) ELSE 0 END AS b FROM c) SELECT page, value AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY page ORDER BY b DESC, value) = 1")
def otsu_threshold(spark, d):
    from corpusflow.operators import images

    return images.otsu(images.histogram(_pixels(spark, d)))


@query("WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]\\s*>', 1) AS h FROM pages) SELECT page_id, len(h)::BIGINT AS n_headings, trim(regexp_replace(regexp_replace(h[1], '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM s WHERE len(h) > 0")
def page_metadata(spark, d):
    from corpusflow.sources import sections

    p = t(spark, d, "pages").select("page_id", sections.html_sections("html").alias("s"))
    got = p.select("page_id", F.size(F.filter("s", lambda x: x["heading"] != "")).cast("long").alias("n_headings"), sections.metadata("s").alias("m"))
    return got.where("n_headings > 0").select("page_id", "n_headings", F.col("m.title").alias("title"))
