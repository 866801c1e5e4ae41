import pytest

from corpusflow.operators import references as R


@pytest.mark.parametrize(
    "text,want",
    [
        ("[1] A first\n entry\n[2] B second\nFigure 3: a caption", ["A first entry", "B second Figure 3: a caption"]),
        ("1. Alpha one. 2. Beta two.", ["Alpha one.", "Beta two."]),
        ("[1] Alpha [2] Beta", ["Alpha", "Beta"]),
        ("Alpha one\nmore\n\nBeta two", ["Alpha one more", "Beta two"]),
        ("Smith, J. A thing (2001)\nand more\nJones, Kim. Other 1999", ["Smith, J. A thing (2001) and more", "Jones, Kim. Other 1999"]),
        ("plain\nlines", ["plain", "lines"]),
        ("", []),
    ],
)
def test_split(text, want):
    assert R.split_references(text) == want


def test_section_and_table(spark):
    text = "Body\nReferences\nnot yet\n7. REFERENCES:\n[1] One\n[2] Two"
    assert R.reference_section(text) == "[1] One\n[2] Two" and R.reference_section("none") == ""
    got = R.references(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.raw) for r in got] == [(1, "One"), (1, "Two")]
