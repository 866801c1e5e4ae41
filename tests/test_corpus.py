"""A small corpus from documents to answers; sections, places, pages and the graph as it grows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusflow.corpus import Corpus
from corpusflow.functions import text as T
from corpusflow.operators import images
from corpusflow.operators.locate import locate
from corpusflow.sources import sections
from corpusflow.streaming import graph

TEXTS = [
    "Entropy measures uncertainty of sources. The entropy of independent sources is additive. Coding theorems follow from entropy.",
    "Entropy bounds compression. Sources with low entropy compress well, as coding theorems state for entropy of sources.",
    "Whales swim through cold oceans. Oceans feed whales with krill, and whales migrate through oceans every year.",
    "Whales migrate. Cold oceans hold krill that whales eat in the cold season of oceans.",
    "Whales migrate. Cold oceans hold krill that whales eat in the cold season of oceans.",
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    c = Corpus(spark, str(tmp_path_factory.mktemp("corpus")))
    docs = spark.createDataFrame([(i, f"study_{i}.pdf", f"Title {i}", t, dt.datetime(2024, 1, 1)) for i, t in enumerate(TEXTS)], "doc_id long, filename string, title string, text string, extracted_at timestamp")
    c.put_documents(docs)
    c.embed()
    c.categorise(0.2)
    c.build_graph()
    return c


def test_stages(corpus):
    assert {r.doc_id for r in corpus.table("documents").collect()} == {0, 1, 2, 3}
    of = {r.doc_id: r.cluster for r in corpus.table("categories").collect()}
    assert of[0] == of[1] != of[2] == of[3]
    best = corpus.ranking(["entropy", "sources"], 2).collect()
    assert len(best) == 2 and {of[r.doc_id] for r in best} == {0, 2}
    with pytest.raises(ValueError):
        corpus.ranking(["x"], 0)
    with pytest.raises(ValueError):
        corpus.categorise(1.5)


def test_questions(corpus):
    hits = corpus.retrieve("What is the entropy of sources?").collect()
    assert {h.doc_id for h in hits} <= {0, 1} and hits[0].score >= hits[-1].score
    named = corpus.retrieve("What does study 1 say on entropy of sources?").collect()
    assert named[0].doc_id == 1 and named[0].boost >= 2
    assert {h.doc_id for h in corpus.retrieve("entropy", [2]).collect()} == {2}
    with pytest.raises(ValueError, match="no indexed chunks"):
        corpus.retrieve("entropy", [77])
    reply, given = corpus.answer("What is additive entropy?")
    assert "additive" in reply and given
    assert {r.s for r in corpus.facts("Why do whales migrate?").collect()} | {r.o for r in corpus.facts("Why do whales migrate?").collect()} >= {"whales"}


def test_delete(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    c.put_documents(spark.createDataFrame([(1, "a.pdf", "A", "some text here"), (2, "b.pdf", "B", "other text here")], "doc_id long, filename string, title string, text string"))
    c.embed()
    before = c.version
    c.delete([1])
    assert c.version > before and [r.doc_id for r in c.table("chunks").select("doc_id").collect()] == [2]


def test_sections(spark):
    d = spark.createDataFrame([("<head><title>x</title></head><p>before</p><h1>The <b>title</b></h1><p>a</p><h2>Abstract</h2>said<table><tr><th>A</th><td>1</td></tr><tr><td>B</td></tr></table>", "pre\n# One\nx\ny\n## Two\n")], "h string, m string")
    r = d.select(sections.html_sections("h").alias("s"), sections.markdown_sections("m").alias("m"), sections.tables("h").alias("t")).select("*", sections.metadata("s").alias("d")).first()
    assert [tuple(x) for x in r.s] == [("", "before"), ("The title", "a"), ("Abstract", "said A 1 B")]
    assert [tuple(x) for x in r.m] == [("", "pre"), ("One", "x y"), ("Two", "")]
    assert r.t == ["| A | 1 |\n| B |"] and tuple(r.d) == ("The title", "said A 1 B")


def test_nul_at_any_depth(spark):
    d = spark.createDataFrame([("a\0", [("b\0", ["c\0", None])], {"k\0": "v\0"}, 1), (None, None, None, None)], "a string, b array<struct<x:string,y:array<string>>>, m map<string,string>, n int")
    r = sections.without_nul(d).collect()
    assert (r[0].a, [(x.x, x.y) for x in r[0].b], r[0].m, r[0].n) == ("a", [("b", ["c", None])], {"k": "v"}, 1) and r[1].b is None


def test_locate(spark):
    words = [f"word{i}" for i in range(50)]
    page = "intro" + "".join(words) + "end"

    def at(page, words):
        row = spark.createDataFrame([(page, words)], "p string, w array<string>").select(locate(F.col("p"), F.col("w")).alias("x")).first().x
        return None if row is None else (row.start, row.end)

    whole = len("".join(words))
    assert at(page, words) == (5, 5 + whole)
    changed = ["other", *words[1:]]  # the first words differ: an anchor behind them, then the tail
    got = at(page, changed)
    assert got is not None and page[got[0] : got[1]].endswith("word49")
    assert at(page, ["by"]) is None and at("", words) is None
    late = words[:12] + ["changed"] + words[13:]
    assert at(page, late) == (5, 5 + whole)


def test_pages(spark):
    px = spark.createDataFrame([("a", 10)] * 50 + [("a", 12)] * 50 + [("a", 200)] * 100 + [("b", 255)] * 199 + [("b", 0)], "page string, value int")
    h = images.histogram(px)
    assert {r.page: r.threshold for r in images.otsu(h).collect()} == {"a": 12, "b": 0}
    assert {r.page: r.blank for r in images.blank(h).collect()} == {"a": False, "b": True}
    p = spark.createDataFrame([(1, 5000, 600, 800, 1), (2, 10, 600, 800, 1), (3, 10, 600, 800, 0)], "page int, chars int, width int, height int, images int")
    assert [(r.has_text, r.image_only) for r in images.has_text(p).orderBy("page").collect()] == [(True, False), (False, True), (False, False)]


def test_graph_grows(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, call int, reply string").coalesce(1).write.mode("append").parquet(src)
    put([(1, 0, '[["a", "p", "b"], ["x", ""]]'), (1, 1, "no list")])
    schema = spark.read.parquet(src).schema
    graph.flush(spark, src, schema, store, ck).awaitTermination()
    put([(2, 0, '[["a", "p", "b"], ["c", "p", "d"]]')])
    q = graph.flush(spark, src, schema, store, ck)
    q.awaitTermination()
    s = spark.read.parquet(store)
    assert {tuple(r) for r in graph.graph(s).collect()} == {("a", "p", "b", 1), ("a", "p", "b", 2), ("c", "p", "d", 2)}
    assert tuple(graph.counters(s).first()) == (3, 1, 3, 1) and not graph.progress(q)["running"]


def test_body_text(spark):
    from corpusflow.operators.selection import body_text

    d = spark.createDataFrame([([("Intro", "a"), ("7. References", "r"), ("X", " ")], "whole"), ([("References", "r")], "whole")], "s array<struct<heading:string,text:string>>, text string")
    assert [r.x for r in d.select(body_text("s", "text").alias("x")).collect()] == ["a", "whole"]
    assert d.select(T.auto_label("text")).first()[0] == "whole"
