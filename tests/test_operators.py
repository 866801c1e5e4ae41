import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.config import GraphFacts
from corpusflow.operators import chunking, citations, grounding, kg, lexical, rank, retrieve, vectors
from corpusflow.operators.components import components
from corpusflow.sources import ingest
from corpusflow.streaming.ingest import ingest as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_percentile_ties_and_single(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 9.0), ("a", 3.0 + 1e-14)], "g string, v double")
    got = {(r.g, round(r.v, 3)): r.pct for r in rank.percentile(df, ["g"], "v").collect()}
    assert got == {("a", 1.0): 0.0, ("a", 2.0): 2 / 5, ("a", 3.0): 4.5 / 5, ("b", 9.0): 1.0}


@pytest.mark.parametrize("k", range(1, 10))
def test_quotas(spark, k):
    sizes = [4, 3, 1, 1]
    df = spark.createDataFrame(list(enumerate(sizes)), "g int, size long")
    got = [r.quota for r in rank.apportion(df, k, "g").orderBy("g").collect()]
    exact = [k * s / 9 for s in sizes]
    want = [math.floor(x) for x in exact]
    for i in sorted(range(4), key=lambda i: (-round(exact[i] - want[i], 12), -sizes[i], i))[: k - sum(want)]:
        want[i] += 1
    assert got == want and sum(got) == k


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = sorted((x, root(x)) for x in {x for a, b in links if a != b for x in (a, b)})
    assert rows(components(spark.createDataFrame(links, "a long, b long"))) == want
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = [(0, 1), (1, 2), (2, 0), (3, 2), (2, 3), (0, 99)]
    got = {r.node: r.rank for r in rank.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), 60).collect()}
    r = np.full(5, 0.2)
    for _ in range(60):
        new = np.full(5, 0.15 / 5)
        for i in range(5):
            out = [d for s, d in edges if s == i and d < 5]
            for d in out or range(5):
                new[d] += 0.85 * r[i] / len(out or range(5))
        r = new
    assert np.allclose([got[i] for i in range(5)], r) and abs(sum(got.values()) - 1) < 1e-9
    even = rank.pagerank(nodes, spark.createDataFrame([], "src long, dst long"), 3)
    assert {round(x.rank, 9) for x in even.collect()} == {0.2}


def test_final_score_leaves_out_missing_citations(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.25)], "representativeness_pct double, novelty_pct double, pr double")
    assert rank.final_score(df).first().final_score == 0.6
    assert rank.final_score(df, pagerank_col="pr").first().final_score == 0.425


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.i, r["rank"]): r.j for r in vectors.knn(df, 3, block=20).collect()}
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    assert got == {(i, k + 1): int(j) for i in range(70) for k, j in enumerate(np.argsort(-sim[i], kind="stable")[:3])}


def test_citations(spark):
    docs = spark.createDataFrame(
        [(1, 0, "Deep learning for materials discovery", ["Smith, A"], "10.1/a"), (2, 1, "Deep learning for materials discovery", ["Jones, B"], "10.1/b"), (3, 2, "Graphs", [], "10.1/B."), (4, 3, "A survey of citation graph analysis methods", ["Lee, C"], None)],
        "doc_id int, ord int, title string, authors array<string>, doi string",
    )
    refs = spark.createDataFrame(
        [(4, 1, "Deep Learning for Materials Discovery!", ["A. Smith"], None), (3, 2, "citation graph analysis methods", [], None), (1, 3, "citation graph analysis methods", ["X. Wrong"], None), (1, 4, None, [], "https://doi.org/10.1/b"), (3, 5, "Graphs", [], None)],
        "src int, ref int, title string, authors array<string>, doi string",
    )
    assert rows(citations.citation_edges(docs, refs)) == [(1, 3), (3, 4), (4, 1)]


CASES = [
    ({"A": ["A", "a"]}, {"B": ["A", "B"]}, {"A": "B", "a": "B", "B": "B"}),
    ({"A": ["A", "a"], "X": ["X", "x"]}, {"B": ["A", "B"]}, {"A": "B", "a": "B", "B": "B", "X": "X", "x": "X"}),
    ({}, {"B": ["A", "B"]}, {"A": "B", "B": "B"}),
    ({"A": ["A", "a"]}, {}, {"A": "A", "a": "A"}),
    ({"A": ["A", "a"], "B": ["B", "b"]}, {"C": ["A", "B", "C"]}, dict.fromkeys("AaBbC", "C")),
    ({"A": ["A", "a"], "B": ["A", "B"]}, {"C": ["B", "C"]}, dict.fromkeys("AaBC", "C")),
]


@pytest.mark.parametrize("old,new,want", CASES)
def test_fold_clusters(spark, old, new, want):
    df = lambda m: spark.createDataFrame([(x, r) for r, xs in m.items() for x in xs], "member string, rep string")
    assert {r.member: r.rep for r in kg.fold_clusters(df(old), df(new)).collect()} == want


def test_graph_facts(spark):
    tri = [("seed", "p", "x", d) for d in (1, 2)] + [("x", "q", "y", 2), ("y", "q", "z", 3), ("hub", "p", "seed", 1)] + [("hub", "p", f"n{d}", d) for d in range(1, 25)] + [("rare", "p", "w", 9)]
    df = spark.createDataFrame(tri, "s string, p string, o string, doc_id int")
    got = {(r.s, r.o): r.score for r in kg.graph_facts(df, ["seed", "rare"], 100, GraphFacts()).collect()}
    w = math.log(100 / 2)
    assert got == pytest.approx({("seed", "x"): w * 2, ("hub", "seed"): w, ("x", "y"): w / 2})
    assert kg.graph_facts(df, ["seed"], 2).count() == 0  # a seed in every document weighs nothing


def test_merge_prune_isolated_clean(spark):
    df = spark.createDataFrame([("Random-Forest", "is", "model", 1), ("random forest", "is", "model", 2), ("ann", "authored", "doc", 1), ("doc", "has", "x", 1), ("x", "is", "x", 1)], "s string, p string, o string, doc_id int")
    m = kg.entity_clusters(kg.name_counts(df))
    assert rows(m) == [("Random-Forest", "Random-Forest"), ("random forest", "Random-Forest")]
    merged = kg.provenance(kg.apply_merge(df, m)).where("s = 'Random-Forest'").first()
    assert merged.doc_ids == [1, 2]
    left = kg.prune(df, {"authored": ("s",)})
    assert rows(kg.isolated(kg.name_counts(df), left)) == [("ann",)]
    junk = spark.createDataFrame([("doc",)], "name string")
    assert rows(kg.clean(df, junk).select("s").distinct()) == [("Random-Forest",), ("random forest",)]


def test_definitions(spark):
    v = spark.createDataFrame([("RF", "random forest", 79), ("RF", "radio frequency", 21), ("CNN", "neural net", 4), ("CNN", "Neural-net", 4), ("ab", "x", 9)], "short string, long string, n long")
    assert rows(kg.dominant_definitions(v).select("short", "n")) == [("CNN", 8)]
    assert rows(kg.dominant_definitions(v, 0.79).select("short", "n")) == [("CNN", 8), ("RF", 79)]


def test_retrieval_floor_and_scope(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma"), (4, None)], "doc_id long, text string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [-1.0, 0.0]), (4, [0.2, 0.0])], "vec_id long, embedding array<double>")
    got = retrieve.retrieve(docs, vec, [1.0, 0.0], ["alphas"]).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and max(r.lex for r in got) == 1.0
    assert [r.doc_id for r in retrieve.retrieve(docs, vec, [1.0, 0.0], ["alpha"], scope=[3]).collect()] == [3]
    with pytest.raises(ValueError):
        retrieve.retrieve(docs, vec, [1.0], ["alpha"])


def test_grounding(spark):
    claims = spark.createDataFrame([(1, 0, "alpha beta gamma delta", True), (2, 0, "alpha beta zeta delta", True), (3, 0, "alpha beta zeta delta", False), (4, 0, "alpha beta", False)], "claim_id int, key int, claim string, quoted boolean")
    chunks = spark.createDataFrame([(0, 7, "pre alpha beta gamma delta post"), (0, 8, "other words")], "key int, chunk_id int, chunk string")
    got = {r.claim_id: (r.chunk_id, r.verified) for r in grounding.verify(claims, chunks).collect()}
    assert got == {1: (7, True), 2: (7, False), 3: (7, True)}


def test_chunker():
    assert chunking.sentences("See Fig. 2 for A. Smith et al. Results. Next one! (Then) more") == ["See Fig. 2 for A. Smith et al. Results.", "Next one!", "(Then) more"]
    text = " ".join(f"Sentence {i} has exactly six words." for i in range(100))
    got = chunking.chunk_text(text, 50)
    assert " ".join(got) == text and max(len(x.split()) for x in got) <= 50
    assert [len(x.split()) for x in chunking.chunk_text("w " * 400, 180)] == [180, 180, 40]
    assert chunking.chunk_text(None) == chunking.chunk_text("  ") == []
    over = chunking.chunk_text(text, 50, 6)
    assert over[1].startswith(over[0].split(". ")[-1][:10])


def test_chunk_document():
    got = chunking.chunk_document("T", [("A", "a b"), ("B", "c d"), ("C", ""), ("D", "w " * 70)], ["x " * 301, "y\tz"], "")
    assert got[0][:4] == ("T — A\na b B. c d C.", "A", 0, "text")
    assert got[1][2] == 3 and got[2][0].endswith(" …") and got[3][0] == "T — Table\ny\tz"


def test_packing_invariants():
    rng = random.Random(3)
    for _ in range(30):
        bodies = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))) for _ in range(12)]
        calls = chunking.pack_bodies(bodies, "HEAD\n", 120)
        assert all(len(c) <= 120 and c.startswith("HEAD\n") and c.count("HEAD") == 1 for c in calls)
        assert " ".join(c[5:] for c in calls).split() == " ".join(bodies).split()
        for b in bodies:
            if b and len(b) <= 115:
                assert any(b in c for c in calls)


def test_ingest(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1"), ("b.pdf", b"no"), ("d.pdf", b"%PDF-1")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in ingest.inspect_files(spark, str(tmp_path)).collect()}
    assert [got[n].error for n in ("a.pdf", "b.pdf", "d.pdf")] == [None, "wrong file type", None]
    assert got["a.pdf"].doc_id == got["a.pdf"].sha256[:16] == got["d.pdf"].doc_id
    good = ingest.inspect_files(spark, str(tmp_path)).where("error IS NULL")
    assert ingest.new_content(good, spark.createDataFrame([], "sha256 string")).count() == 1
    assert ingest.new_content(good, good).count() == 0
    docs = spark.sql("SELECT 1 AS doc_id, timestamp'2024-01-02' AS extracted_at UNION ALL SELECT 2, timestamp'2024-01-02' UNION ALL SELECT 3, timestamp'2024-01-02'")
    chunks = spark.sql("SELECT 1 AS doc_id, timestamp'2024-01-03' AS ingested_at UNION ALL SELECT 2, timestamp'2024-01-01'")
    assert rows(ingest.stale(docs, chunks)) == [(2,), (3,)]


def test_streaming_ingest_takes_each_content_once(spark, tmp_path):
    src, store, cp = (str(tmp_path / x) for x in ("src", "store", "cp"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    df.coalesce(1).write.parquet(src)
    for _ in range(2):
        stream(spark, src, df.schema, store, cp).awaitTermination(60)
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    stream(spark, src, df.schema, store, cp).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]


def test_window_tail_rule_and_top_m(spark):
    docs = spark.createDataFrame([(1, "alpha " * 200), (2, "alpha " * 10), (3, "beta " * 230)], "doc_id long, text string")
    got = {(r.doc_id, r.win): r.n_tokens for r in rank.window_scores(docs, ["alpha"]).collect()}
    assert got == {(1, 0): 180, (2, 0): 10, (3, 0): 180, (3, 1): 50}
    assert {r.doc_id for r in rank.top_m(rank.window_scores(docs, ["alpha"])).collect()} == {1, 2, 3}


def test_bm25_plural_fallback(spark):
    docs = spark.createDataFrame([(1, "cats cat"), (2, "dogs"), (3, "bird")], "doc_id long, text string")
    got = {r.doc_id: r.lex for r in lexical.bm25_squared(docs, ["cats", "birds"]).collect()}
    assert got[1] > 0 and got[2] == 0 and got[3] > 0


def test_minmax_without_span(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert rows(vectors.minmax(df, ["x", "y"])) == [(-1.0, 0.0), (1.0, 0.0)]
    assert vectors.minmax(df.where(F.lit(False)), ["x", "y"]).count() == 0
