"""Selection, grounding, predicates, records and the text functions on literal rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import citations, kg, marks, predicates, rank, retrieve, selection
from corpusflow.protocols import Extractive, HashedTerms, HtmlText, PlainText, TermEntailment, embed_table
from corpusflow.sources import records


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_surnames(spark):
    for name, want in [("van der Berg, Aidan", "berg"), ("Gomez, Aidan N.", "gomez"), ("Aidan N. Gomez", "gomez"), ("Ö'Neil-Smith", "ö'neil-smith"), ("X", None), (None, None)]:
        assert one(spark, T.surname("a"), a=name) == want


def test_dates(spark):
    at = lambda s: one(spark, T.latest_date("a", 2024, 6), a=s)
    for said, want in [("Jan 5, 2020", (2020, 1)), ("5 Sept. 2020", (2020, 9)), ("June 2017 and 2017", (2017, 6)), ("in 1687", (1687, 0)), ("July 2024, May 2024", (2024, 5)), ("2019-11-02", (2019, 11)), ("Junk 2018", (2018, 6)), ("Foo 2018", (2018, 0)), ("1599 2100", None), (None, None)]:
        assert at(said) == want, said


def test_titles_within_words(spark):
    docs = spark.createDataFrame([(1, "we cite transformers here"), (2, "x alpha betagamma y"), (3, "xalpha beta"), (4, "one two three four"), (5, None), (6, "atwo three fourb zone two three fourth")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Transformers"), (2, "alpha beta"), (3, "two three four"), (4, ""), (5, "form"), (6, "zone two three fourth of")], "item_id long, text string")
    want = {(1, 1), (2, 2), (3, 2), (4, 3), (6, 3), (1, 5)}
    for bound in (100, 0):
        assert {tuple(r) for r in citations.contained_titles(docs, items, broadcast_keys=bound).collect()} == want


def test_words(spark):
    assert one(spark, T.norm_words("a"), a="Éﬁn d'ÀLBERT – x²") == ["efin", "d", "albert", "x2"]
    assert one(spark, T.keyword_tokens("a"), a="Cars, évaluations of bus and CARS") == ["car", "valuation", "bu", "and"]
    assert one(spark, T.viewer_sentences("a"), a="Short one. This sentence is long enough to be kept. 3 more words are in this sentence too.") == ["This sentence is long enough to be kept.", "3 more words are in this sentence too."]
    assert one(spark, T.clean_title("a"), a="All rights reserved. Published by X. The real title. More") == "The real title. More"
    assert one(spark, T.clean_title("a"), a="All rights reserved.") is None
    assert one(spark, T.clean_title("a"), a="A plain title") == "A plain title"
    assert one(spark, T.meta_text("a", "b", "c", 2), a=" ", b=None, c="one two three") == "one two"
    assert one(spark, T.meta_text("a", "b", "c"), a="T", b="A", c="x") == "T\nA"
    assert one(spark, T.clean_body("a", "n"), a="T — H\nbody", n=6) == "body"
    assert one(spark, T.chunk_title("a", "n", "f"), a="T — H\nbody", n=6, f="f.pdf") == "T"
    assert one(spark, T.chunk_title("a", "n", "f"), a="body", n=0, f="f.pdf") == "f.pdf"
    assert one(spark, T.fill_template("a", q="b"), a="{q} {r} {q}", b="{q}") == "{q} {r} {q}"
    assert one(spark, T.auto_label("a", 4), a=" abcdef") == "abcd"
    assert one(spark, T.first_filled("a", "b"), a="  ", b="x") == "x"
    assert one(spark, T.partial_date("a", "b", 2024, 6), a=2024, b=7) is None
    assert tuple(one(spark, T.partial_date("a", "b", 2024, 6), a=2023, b=13)) == (2023, None)
    got = one(spark, T.page_span((F.lit(None).cast("int"), F.lit(None).cast("int")), (F.lit(3), F.lit(4))), a="x")
    assert tuple(got) == (3, 4)


def test_parse(spark):
    got = one(spark, T.parse_triples("a"), a='Sure!\n```json\n[["a", "b [c]", "d"], {"subject": "s", "predicate": "p", "object": "o"}, ["x", "", "y"], [1, 2, 3], ["cut')
    assert [tuple(x) for x in got.kept] == [("a", "b [c]", "d"), ("s", "p", "o")] and (got.dropped, got.failed) == (2, False)
    for text in (None, "", "[]", "no list"):
        got = one(spark, T.parse_triples("a"), a=text)
        assert got.failed and got.dropped == 0
    q = one(spark, T.parse_query("a", "b"), a='```json\n{"keywords": ["x", "y"], "confidence": 7}\n```', b="z")
    assert (q.keywords, q.confidence) == (["x", "y"], 1.0)
    q = one(spark, T.parse_query("a", "b"), a="not json", b="What is the entropy of entropy")
    assert (q.keywords, q.confidence) == (["what", "entropy"], 0.0)


CHUNKS = ["Entropy is additive for independent sources, as the theorem states plainly.", "A machine computes every number whose decimal can be written down."]


def test_repair():
    text = 'He says "entropy is additive for independent sources" [2]. A machine computes numbers written down [1, 9]. Nothing of this sort was ever found anywhere [2]. Bananas grow quickly in warm rain [7] .'
    fixed, quotes = marks.repair(text, CHUNKS)
    # every marker within 400 characters of a quote is the quote's
    assert fixed == 'He says "entropy is additive for independent sources" [1]. A machine computes numbers written down [1]. Nothing of this sort was ever found anywhere [1]. Bananas grow quickly in warm rain [1].'
    assert quotes[0] == ["entropy is additive for independent sources"]
    # far from the quote, sentences count
    far = "x " * 250
    fixed, _ = marks.repair(f"A machine computes numbers written down [1]. {far}Bananas grow quickly in warm rain [7] . {far}Whales swim over deep cold oceans [2].", CHUNKS)
    assert "written down [2]." in fixed and "rain [!]." in fixed and "oceans [2!]." in fixed
    assert marks.repair("as is [1]", []) == ("as is [1]", [])
    # a quote that no chunk has is not saved by its terms
    fixed, _ = marks.repair('"sources additive independent entropy plainly states" [1]', CHUNKS)
    assert fixed.endswith("[1!]")


def test_sentences_at_markers():
    t = "First claim stands here.\n[1]\nSecond claim goes [2] on here. Third"
    got = marks.marks(t)
    assert [m.claim for m in got] == ["First claim stands here.", "Second claim goes on here."]
    assert marks.citing_sentences("A claim. [1]") == ["A claim."] and marks.citing_sentences("A claim. [1]\n\nNext one. [2!] [!]") == ["Next one."] * 3
    assert [s[2] for s in marks.quoted_spans("> quoted line\nplain\n  > next")] == ["quoted line", "next"]


def test_similarity_saves_a_paraphrase():
    vec = np.eye(2)
    claim = "Quite other words express it thus [1]."
    assert marks.repair(claim, CHUNKS, vec, lambda xs: np.array([[0.1, 0.9]]))[0].endswith("[2].")
    assert marks.repair(claim, CHUNKS, vec, lambda xs: np.array([[0.5, 0.5]]))[0].endswith("[1!].")


def test_ground_replies(spark):
    r = spark.createDataFrame([(1, "A machine computes numbers written down [1]."), (2, None), (3, "none [1]")], "reply_id long, reply string")
    c = spark.createDataFrame([(1, k, t) for k, t in enumerate(CHUNKS)] + [(2, 0, "x")], "reply_id long, rank int, text string")
    got = {x.reply_id: x.reply for x in marks.ground_replies(r, c).collect()}
    assert got == {1: "A machine computes numbers written down [2].", 2: None, 3: "none [1]"}


def test_nearest_spans(spark):
    m = spark.createDataFrame([(1, 0, 100), (1, 1, 205), (1, 2, 9000), (2, 3, 5)], "key long, mark long, at long")
    s = spark.createDataFrame([(1, 0, 10, 90), (1, 1, 200, 210), (1, 2, 400, 500)], "key long, span long, start long, end long")
    assert sorted((r.mark, r.span, r.gap) for r in marks.nearest_spans(m, s).collect()) == [(0, 0, 10), (1, 1, 0)]


def test_summaries(spark):
    rows = [(1, 0, "1. Abstract", "abs", "given"), (1, 1, "Methods", "m", "given"), (1, 2, "Conclusions", "c" * 3990, "given"), (1, 3, "Conclusion", "d" * 20, "given"), (2, 0, "Intro", "i", None), (2, 1, "References", "r", None), (3, 5, "Conclusion", "e" * 9000, None), (3, 6, "Conclusion", "f", None)]
    c = spark.createDataFrame(rows, "doc_id long, chunk_index long, heading string, body string, abstract string")
    got = sorted((r.doc_id, r.chunk_index) for r in selection.summary_entries(c).collect())
    assert got == [(1, -1), (1, 2), (2, 0), (3, 5)]
    scored = c.withColumn("score", F.when(F.col("doc_id") == 1, F.col("chunk_index")))
    got = sorted((r.doc_id, r.chunk_index) for r in selection.scored_summary_entries(scored).collect())
    assert got == [(1, -1), (1, 2), (2, 0), (3, 5)]  # of the best two, the later one does not fit


def test_call_order(spark):
    docs = spark.createDataFrame([(10, 0, None), (11, 1, 2), (12, 2, 1), (13, 3, None), (14, 4, None)], "doc_id long, ordinal long, rank long")
    got = sorted((r.place, r.doc_id, r.full) for r in selection.split_documents(docs).collect())
    assert got == [(1, 12, True), (2, 11, True), (3, 10, False), (4, 13, False), (5, 14, False)]
    c = spark.createDataFrame([(d, k, "Methods", f"body {d} {k}", None) for d in range(10, 15) for k in (0, 1)], "doc_id long, chunk_index long, heading string, body string, abstract string")
    entries = selection.call_entries(c, docs)
    assert {(r.doc_id, r.chunk_index) for r in entries.collect()} == {(12, 0), (12, 1), (11, 0), (11, 1), (10, 0), (13, 0), (14, 0)}
    calls = selection.call_batches(entries, docs.select("doc_id", F.lit("T").alias("title")), 60).collect()
    assert all(len(r.text) <= 60 and r.text.startswith("# T\n") for r in calls) and {r.doc_id for r in calls} == set(range(10, 15))


def test_retry():
    seen = []

    def model(text, temperature):
        seen.append((text, temperature))
        return None if "bad" in text and temperature < 0.5 else [text]

    assert selection.generate(["good", "bad", "fine"], model) == ["good", "bad", "fine"]
    assert seen[0] == ("good\n\nbad\n\nfine", 0.0) and ("bad", 0.7) in seen
    assert selection.generate(["x"], lambda t, s: None) is None
    a, b = selection.halves(["w " * 1000])
    assert abs(len(a[0]) - len(b[0])) < 10 and selection.halves(["short"]) == [["short"]]
    assert selection.budget_chars(None, True) == (8192, 5896, 4096) and selection.budget_chars(1_000_000, False) == (1_000_000, 48_000, 16_000)


def test_predicates(spark):
    names = ["improves accuracy", "accuracy improves", "is improved by", "uses"]
    p = spark.createDataFrame([(k, n, [1.0, 0.0] if k < 3 else [0.0, 1.0]) for k, n in enumerate(names)], "id long, predicate string, vec array<double>")
    pairs = predicates.candidate_pairs(p)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1)]
    tri = spark.createDataFrame([("a", "improves accuracy", "b", 1), ("c", "accuracy improves", "d", 2), ("e", "accuracy improves", "f", 2), ("a", "uses", "b", 1)], "s string, p string, o string, doc_id long")
    assert {r.p for r in predicates.normalise(tri, p, 0.75, TermEntailment()).collect()} == {"accuracy improves", "uses"}
    assert {r.p for r in predicates.normalise(tri, p.where("id = 3")).collect()} == {"improves accuracy", "accuracy improves", "uses"}


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>The title</title></titleStmt><publicationStmt><date when="2019-03">x</date></publicationStmt><sourceDesc><biblStruct><analytic><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author><author><persName><forename>Bo</forename><surname>Oh</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>What it says.</p></abstract></profileDesc></teiHeader><text><back><listBibl>
<biblStruct xml:id="b0"><analytic><title>First ref</title><author><persName><forename>C</forename><surname>D</surname></persName></author></analytic><monogr><title>Journal</title></monogr></biblStruct><biblStruct xml:id="b1"><monogr><title>A book</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    d = spark.createDataFrame([(1, TEI)], "doc_id long, xml string")
    h = d.select(records.tei_header("xml").alias("h")).first().h
    assert (h.title, h.authors, h.abstract, h.year) == ("The title", ["Ann Lee", "Bo Oh"], "What it says.", 2019)
    got = sorted((r.ref, r.title, tuple(r.authors)) for r in records.tei_references(d).collect())
    assert got == [(1, "First ref", ("C D",)), (2, "A book", ())]


def test_crossref(spark):
    reply = '{"message": {"DOI": "10.1/x", "title": ["New title"], "author": [{"given": "A", "family": "B"}, {}], "abstract": "<jats:p>Abstract: said</jats:p>", "issued": {"date-parts": [[2020, 5]]}, "is-referenced-by-count": 7}}'
    works = records.crossref_works(spark.createDataFrame([("10.1/X", reply), ("10.1/miss", None)], "doi string, reply string"), 2024, 6)
    docs = spark.createDataFrame([(1, "https://doi.org/10.1/x", "old", None), (2, "10.1/miss", "kept", "a"), (3, None, "none", None), (4, "10.1/new", "new", None)], "doc_id long, doi string, title string, abstract string")
    docs = docs.withColumn("authors", F.array(F.lit("Z"))).withColumn("created", F.lit(None).cast("struct<year:int,month:int>")).withColumn("cited_by", F.lit(None).cast("int"))
    got = {r.doc_id: (r.title, r.authors, r.abstract, r.created, r.cited_by) for r in records.enrich(docs, works).collect()}
    assert got[1] == ("New title", ["A B"], "said", (2020, 5), 7) and got[2] == ("kept", ["Z"], "a", None, None) and got[3][0] == "none"
    assert [r.doi for r in records.unknown_dois(docs, works).collect()] == ["10.1/new"]


def test_files(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([(1, [1.0])], "doc_id long, vec array<double>")
    records.export(a, p)
    records.export(a.union(a), p, vectors=False)
    assert spark.read.parquet(p).count() == 2 and spark.read.parquet(p).columns == ["doc_id"]
    assert records.abbreviations(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text('[{"id": "m", "context": 4096, "local": true}]')
    assert [tuple(r) for r in records.models(spark, str(tmp_path / "m.json")).collect()] == [("m", 4096, True)]
    (tmp_path / "bad.json").write_text("{nope")
    assert records.models(spark, str(tmp_path / "bad.json")).count() == 0
    log = spark.createDataFrame([(1, "q", "c", "r")], "chat_id long, prompt string, context string, reply string")
    for _ in (0, 1):
        records.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    tri = spark.createDataFrame([("a<", "p", "b", 1)], "s string, p string, o string, doc_id long")
    records.render_graph(tri, str(tmp_path / "g.html"))
    assert "a&lt;" in (tmp_path / "g.html").read_text()


def test_records(spark):
    d = spark.createDataFrame([(1, "done", dt.datetime(2024, 1, 1), "me"), (2, "new", dt.datetime(2024, 1, 2), "you"), (3, "done", dt.datetime(2024, 1, 3), "me")], "doc_id long, status string, uploaded_at timestamp, owner_id string")
    assert [r.doc_id for r in records.list_documents(d).collect()] == [3, 2, 1] and [r.doc_id for r in records.list_documents(d, "done").collect()] == [3, 1]
    assert {r.doc_id for r in records.owned(d, "me").collect()} == {1, 3}
    c = spark.createDataFrame([("1_0", 1)], "chunk_id string, doc_id long")
    assert records.lookup(c, "1_0").first().doc_id == 1
    with pytest.raises(KeyError):
        records.lookup(c, "1_1")


def test_rechunk(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    docs = spark.createDataFrame([(1, "fresh", at(1)), (2, "changed", at(5)), (3, "  ", at(5)), (4, "new", at(1))], "doc_id long, text string, extracted_at timestamp")
    store = spark.createDataFrame([(1, "old", at(2)), (2, "old", at(2)), (3, "old", at(2)), (9, "gone", at(2))], "doc_id long, chunk string, ingested_at timestamp")
    got = records.rechunk(docs, store, lambda d: d.select("doc_id", F.col("text").alias("chunk")))
    assert sorted((r.doc_id, r.chunk) for r in got.collect()) == [(1, "old"), (2, "changed"), (4, "new"), (9, "gone")]


def test_prompts(spark):
    q = spark.createDataFrame([(1, "why"), (2, "how")], "query_id long, question string")
    context = spark.createDataFrame([(1, "[1] a\nx")], "query_id long, context string")
    facts = retrieve.facts_text(spark.createDataFrame([(2, 1, "c", "d", "e"), (2, 0, "a", "b", "c")], "query_id long, place int, s string, p string, o string"))
    got = {r.query_id: r.prompt for r in retrieve.prompts(q, context, facts, "P {question}: {context}", "F {question}: {context}|{facts}").collect()}
    assert got == {1: "P why: [1] a\nx", 2: "F how: |- a b c\n- c d e"}


def test_scope_without_documents(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="no indexed chunks"):
        retrieve.retrieve(docs, v, [1.0, 0.0], ["words"], [5])


def test_positions(spark):
    d = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    assert all(r.position == r.k + 1 for r in rank.positions(d, ["k"]).collect())


def test_titles_are_no_entities(spark):
    tri = spark.createDataFrame([("The  Paper", "uses", "x", 1), ("a", "p", "b", 1)], "s string, p string, o string, doc_id long")
    junk, titles = spark.createDataFrame([], "name string"), spark.createDataFrame([("the paper",), (None,)], "title string")
    assert [r.s for r in kg.clean(tri, junk, titles).collect()] == ["a"]


def test_protocols(spark):
    e = HashedTerms(64)
    v = e.embed(["entropy of sources", "sources of entropy", "", "bananas grow"])
    assert np.allclose(v[0], v[1]) and not v[2].any() and np.allclose(np.linalg.norm(v[[0, 3]], axis=1), 1)
    d = embed_table(spark.createDataFrame([(1, "entropy of sources"), (2, None)], "id long, text string"), e)
    assert np.allclose([r.vec for r in d.orderBy("id").collect()][0], v[0])
    assert Extractive(1).generate("what is entropy", "Bananas grow. Entropy is additive. More.") == "Entropy is additive."
    b = spark.createDataFrame([(bytearray(b"<p>a\0b</p><script>x</script>"),)], "c binary")
    assert b.select(HtmlText().text(F.col("c"))).first()[0] == "ab" and b.select(PlainText().text(F.col("c"))).first()[0].startswith("<p>ab")
    t = spark.createDataFrame([("x",)], "k string")
    assert t.select(TermEntailment().entails(F.lit("is a kind of method"), F.lit("is a method"))).first()[0] == 1.0
