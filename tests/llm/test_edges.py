"""Nulls, empty and long texts, ties and repeated rows, empty tables and extra columns: no operator fails on any."""

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, html_extract, language_id, packing, quality_classifier, quality_rules, secrets, simhash_dedup, suffix_dedup, toxicity

LONG = " ".join(f"word{i % 977} and some" for i in range(8000))
TEXTS = [None, "", "   \n\t", "!!! ???", "one", LONG, LONG, "the cat sat on the mat " * 40, "токен = ä ß 東京 " * 30, "password: hunter22 " * 3]
EXTRA = "th long, fp long, h string, w string, score double, found string, start int, sequence_id string, label int, b binary, hs string, n int"


def docs(spark, empty=False):
    rows = [] if empty else [(None if i == 9 else i // 2 + 10 if i > 4 else i, t, "en" if i % 2 else None, None, 3) for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", ")))


def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat"), (2, None), (3, ""), (4, "two words"), (None, "a b c d e f")], "item_id long, text string")


def labels(spark, empty):
    return spark.createDataFrame([] if empty else [(12, 1, 0), (3, 0, 1), (4, 1, None), (13, None, 0), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def tok():
    return packing.Packing(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


OPS = {
    "op2": lambda s, d, e: language_id.identify(d, language_id.train(d)),
    "op3": lambda s, d, e: quality_rules.quality_rules(d),
    "op4": lambda s, d, e: quality_classifier.score(d, quality_classifier.train(d, labels(s, e))),
    "op6": lambda s, d, e: simhash_dedup.dedup(d),
    "op7": lambda s, d, e: packing.pack(d, tok()).where("start = 0"),
    "op8": lambda s, d, e: secrets.scan(d, secrets.train(secrets.random_strings(s).unionByName(secrets.corpus_samples(d)))),
    "op9": lambda s, d, e: suffix_dedup.dedup(d),
    "op10": lambda s, d, e: toxicity.score(d, toxicity.train(d, labels(s, e))),
}


@pytest.mark.parametrize("op", OPS)
def test_every_row_has_a_result(spark, op):
    d = docs(spark)
    got = OPS[op](spark, d, False)
    ids = sorted((r.doc_id for r in got.select("doc_id").collect()), key=str)
    assert ids == sorted((r.doc_id for r in d.select("doc_id").collect()), key=str)
    none = OPS[op](spark, docs(spark, True), True)
    assert none.count() == 0 and none.schema == got.schema


def test_decontaminate(spark):
    got = decontaminate.matches(docs(spark), bench(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(13, 1)} and all(r.similarity == 1.0 for r in got)
    assert decontaminate.matches(docs(spark, True), bench(spark)).count() == 0
    assert decontaminate.matches(docs(spark), bench(spark).where("false")).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>A sentence that is long enough to be kept, surely.</p>"), (4, "u", "<" * 50), (4, "u", "<div" * 2000), (5, "u", "<p>x" * 3000), (6, "u", "<div>" * 5000 + "A text far below, long enough to be kept by anyone."), (7, "u", "<a href=\"x>" * 3000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = html_extract.extract_pages(p).collect()
    assert len(got) == 8 and got[0].text == got[1].text == "" and got[2].text.startswith("A sentence")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(p.where("false")).count() == 0


def test_definitions_of_empty_texts(spark):
    d = docs(spark).where("doc_id < 4")
    assert {r.lang_pred for r in OPS["op2"](spark, d, False).collect()} == {"und"}
    assert {r.fingerprint for r in OPS["op6"](spark, d.where("doc_id < 3"), False).collect()} == {"0" * 16}
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in OPS["op3"](spark, d.where("doc_id < 3"), False).collect())
    assert all(r.n_removed == 0 for r in OPS["op9"](spark, d.where("doc_id < 3"), False).collect())
