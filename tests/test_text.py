import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "made,want",
    [
        (lambda: T.tokens(F.lit("The Cat's 3 cats, are ON a naïve Mat")), ["cat", "cats", "mat"]),
        (lambda: T.tokens(F.lit(None).cast("string")), []),
        (lambda: T.norm_heading(F.lit(" VII) References. ")), "references"),
        (lambda: T.norm_heading(F.lit("7. Works Cited:")), "works cited"),
        (lambda: T.norm_title(F.lit("  A Study: of (Things) ")), "a study of things"),
        (lambda: T.norm_doi(F.lit(" https://doi.org/10.1000/AbC. ")), "10.1000/abc"),
        (lambda: T.norm_doi(F.lit("doi:10.1/x")), "10.1/x"),
        (lambda: T.find_doi(F.lit("see 10.1000/xyz-1). more")), "10.1000/xyz-1"),
        (lambda: T.find_doi(F.lit("none")), None),
        (lambda: T.surname(F.lit("Müller, Anna")), "müller"),
        (lambda: T.surname(F.lit("Anna B. O'Neil")), "o'neil"),
        (lambda: T.index_tokens(F.lit("On the of")), ["on", "the", "of"]),
        (lambda: T.resolution_key(F.lit("Random-Forest")), "randomforest"),
        (lambda: T.resolution_key(F.lit("random forest")), "randomforest"),
        (lambda: T.resolution_key(F.lit("CO")), "CO"),
        (lambda: T.resolution_key(F.lit("Co")), "Co"),
        (lambda: T.resolution_key(F.lit("BaTiO3")), "BaTiO3"),
        (lambda: T.resolution_key(F.lit("SCIKIT-LEARN")), "scikitlearn"),
        (lambda: T.is_acronym(F.lit("Ab")), False),
        (lambda: T.is_acronym(F.lit("AbC")), True),
        (lambda: T.is_inverse_voice(F.lit("made by")), True),
        (lambda: T.strip_jats(F.lit("<p>Abstract: It   works</p>")), "It works"),
        (lambda: T.normalize_doc_name(F.lit("1.10_Oral  Repd.pdf")), "1.10 oral repd"),
        (lambda: T.numbers(F.lit("1.10 and 2, 2")), ["1.10", "2"]),
        (lambda: T.normalize_citations(F.lit("a [n1] b [source 2] c [9] d [1](u) e [1, 9]"), 3), "a [1] b [2] c [9] d [1] e [1]"),
    ],
)
def test_scalar(spark, made, want):
    assert one(spark, made()) == want


@pytest.mark.parametrize("text,want", [("March 3rd, 2019 and 2018", (2019, 3)), ("2019-04", (2019, 4)), ("in 2021", (2021, 0)), ("May 2031, 2019", (2019, 0)), ("", None)])
def test_latest_date(spark, text, want):
    got = one(spark, T.latest_date(F.lit(text), 2024, 6))
    assert (tuple(got) if got else None) == want
