"""Steps whose shuffles, repeated reads or memory grew too fast: what they do now, and that results stay."""

from pyspark.sql import functions as F

from corpusflow.operators import grounding, kg, lexical
from corpusflow.operators.components import maybe_in


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_binds_what_is_shared(spark):
    rows = [(["a", "a", "b", "c"], ["a", "c", "c", "z"]), (["a", "b"], []), (["a"], ["a"])]
    df = spark.createDataFrame(rows, "ct array<string>, kt array<string>")
    got = df.select(grounding.overlap(F.col("ct"), F.col("kt")).alias("x"))
    assert [r.x for r in got.collect()] == [0.75, 0.0, 1.0]
    assert "array_intersect" in _physical(got)


def test_sources_by_numbers_of_terms(spark):
    claims = spark.createDataFrame([(1, "alpha alpha beta gamma"), (2, "delta epsilon zeta theta"), (3, "too short"), (4, "alpha kappa lambda sigma")], "claim_id long, claim string")
    chunks = spark.createDataFrame([(1, "alpha words beta"), (2, "gamma beta words beta"), (3, "alpha"), (4, None), (5, "theta delta zeta epsilon alpha")], "chunk_id long, chunk string")
    got = grounding.sources(claims, chunks)
    assert {(r.claim_id, r.chunk_id, r.overlap) for r in got.collect()} == {(1, 1, 0.75), (1, 2, 0.5), (1, 3, 0.5), (1, 5, 0.5), (2, 5, 1.0)}
    # whole texts meet no claims any more
    assert "array<string>" not in got.schema.simpleString() and "regexp_extract_all" not in _physical(got)


def test_terms_of_unlike_ids_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, "beta gamma"), (None, "beta")], "doc_id long, text string")
    own = lexical.own_terms(docs)
    assert "Exchange" not in _physical(own)
    assert {(r.term, r.df) for r in lexical.doc_freq(own, 3).collect()} == {("alpha", 1), ("beta", 3), ("gamma", 1)}
    shared = docs.unionByName(spark.createDataFrame([(1, "beta delta")], "doc_id long, text string"))
    assert {(r.term, r.df) for r in lexical.doc_freq(lexical.own_terms(shared), 3).collect()} == {("alpha", 1), ("beta", 3), ("gamma", 1), ("delta", 1)}


def test_group_keywords_count_shared_ids_once(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta", 0), (1, "alpha", 0), (2, "beta", 1)], "doc_id long, text string, g int")
    got = {(r.g, r.term): r.score for r in lexical.group_keywords(docs, "g").collect()}
    idf = {r.term: r.idf for r in lexical.doc_freq(lexical.own_terms(docs), 3).collect()}
    assert got == {(0, "alpha"): 3 * idf["alpha"], (0, "beta"): idf["beta"], (1, "beta"): idf["beta"]}


def test_lists_of_documents_are_dealt_once(spark):
    tri = spark.createDataFrame([("a", "x", "b", 2), ("a", "x", "b", 1), ("a", "y", "b", 1), ("b", "x", "a", 3)], "s string, p string, o string, doc_id long")
    got = kg.provenance(tri)
    assert _physical(got).split("Initial Plan")[0].count("Exchange") == 1
    assert {(r.s, r.p, r.o, tuple(r.doc_ids)) for r in got.collect()} == {("a", "x", "b", (1, 2)), ("a", "y", "b", (1,)), ("b", "x", "a", (3,))}
    said = kg.provenance(tri.withColumn("p", F.lit("x")))
    assert _physical(said).split("Initial Plan")[0].count("Exchange") == 1


def test_names_that_stay_join_nothing(spark):
    rows = [("c1", "authored", f"o{k}", k) for k in range(50)] + [(f"o{k}", "has status", "open", k) for k in range(50)] + [("q", "has status", "c1", 99), (None, "p", "z", 7)]
    tri = spark.createDataFrame(rows, "s string, p string, o string, doc_id long")
    got = kg.prune(tri, {"authored": ("s",)})
    assert sorted((r.s or "", r.o) for r in got.collect()) == sorted([(f"o{k}", "open") for k in range(50)] + [("", "z")])
    assert "Union" in _physical(got)
    flagged = maybe_in(tri, spark.createDataFrame([("c1",)], "name string"), "name", "m", "s")
    assert {r.s for r in flagged.where("m").collect()} == {"c1"} and flagged.count() == len(rows)
    assert {r.name for r in kg.isolated(kg.names(tri.where("s IS NOT NULL")), got).collect()} == {"c1", "q"}
    m = spark.createDataFrame([("c1", "c"), ("open", "o1")], "member string, rep string")
    merged = {(r.s, r.o, r.doc_id) for r in kg.apply_merge(tri, m).collect()}
    assert merged == {("c", f"o{k}", k) for k in range(50)} | {(f"o{k}", "o1", k) for k in range(50)} | {("q", "c", 99), (None, "z", 7)}


def test_mentions_are_the_ends_of_triples(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alone"), (3, None), (4, "beta beta gamma"), (4, "gamma delta")], "doc_id long, text string")
    want = {(r.name, r.df) for r in kg.entity_df(kg.token_triples(docs)).collect()}
    assert {(r.name, r.df) for r in kg.mention_df(kg.token_mentions(docs)).collect()} == want == {("alpha", 1), ("beta", 2), ("gamma", 1), ("delta", 1)}


def test_names_are_counted_once(spark):
    counts = spark.createDataFrame([("Data-Set", 3), ("dataset", 1), ("other", 2)], "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    got = kg.entity_clusters(counts)
    assert {(r.member, r.rep) for r in got.collect()} == {("Data-Set", "Data-Set"), ("dataset", "Data-Set")}
    assert "LocalTableScan" not in _physical(got) and "ExistingRDD" not in _physical(got)
