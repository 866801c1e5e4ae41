"""Pages with elements left open and long attributes."""

import time

import pytest

from corpusflow.llm import html_extract

TEXT = "A paragraph that is long enough to be the text of an article, with an end."


@pytest.mark.parametrize(
    "head",
    [
        "<select><option>A<option>B</select>",
        "<select><option>A<optgroup label=x><option>B<option>C</select>",
        "<select><option>A<select>",
        "<datalist><option>A<option>B</datalist>",
        "<div><option>A<option>B</div>",
        "<ul><li><select><option>A<li>x</ul>",
        "<select><option>A</option><option>B</option></select>",
        "<div><object><p>x</p></div></object>",
    ],
)
def test_open_options(head):
    assert html_extract.extract(f"<body>{head}<article><p>{TEXT}</p></article>")[0] == TEXT


def test_options_stay_out():
    got = [b.text for b in html_extract.blocks(f"<body><p>one</p><select><option>A<option>B<option>C</select><article><p>{TEXT}</p><button><svg>x</svg>go</button></article>")]
    assert got == ["one", TEXT]


@pytest.mark.parametrize("q", "\"'")
def test_long_attribute(q):
    page = f"<body><div data-x={q}{'<b>xy</b>' * 200_000}{q}><article><p>{TEXT}</p></article></div>"
    assert [b.text for b in html_extract.blocks(page)] == [TEXT]


@pytest.mark.parametrize("piece", ["<a b=\"", "<a b='", "<a b=\"c'", "<a \"<b '", "<a b='\"' c=\"", "<a b=\"<\" '"])
def test_open_quotes_take_linear_time(piece):
    start = time.process_time()
    html_extract.blocks(piece * 100_000)
    html_extract.blocks(piece * 99_999 + "'" + "x" * 100_000)
    assert time.process_time() - start < 20
