"""The minimum cut of pages: against all labellings, and what it adds to the classifier's signs."""

import random

import pytest

from corpusflow.llm import html_extract as h

LINE = "This paragraph has enough words to speak for itself, and it ends as sentences do."


def cost(nodes, label):
    own = sum(max(b.score, 0.0) if not v else max(-b.score, 0.0) for b, v in zip(nodes, label))
    return own + sum(x for i, b in enumerate(nodes) for j, x in b.edges.items() if label[i] and not label[j])


def least(nodes):
    n = len(nodes)
    return min(cost(nodes, [k >> i & 1 for i in range(n)]) for k in range(1 << n))


def test_directed_edges():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        bs = [h.Block(h.Node("p", None, 0), "x", 0, rng.uniform(-3, 3)) for _ in range(n)]
        for i in range(n):
            for j in range(n):
                if i != j and rng.random() < 0.5:
                    bs[i].edges[j] = rng.choice([0.25, 0.5, 1.0, 2.0])
        assert cost(bs, h.cut(bs)) == pytest.approx(least(bs))


@pytest.mark.parametrize("seed", range(30))
def test_pages(seed):
    rng = random.Random(seed)
    piece = lambda: rng.choice(["<p>Er the.</p>", f"<p>{LINE}</p>", "<ul><li><a href=x>link</a><li>short</ul>", "<h2>Two words</h2>", '<div class="ad">Buy now.</div>'])
    page = "<body>" + "".join(piece() for _ in range(rng.randint(0, 2))) + "<article>" + "".join(piece() for _ in range(rng.randint(1, 3))) + "</article><footer>End of it.</footer>"
    bs = h.blocks(page)
    h.classify(bs, h.Weights())
    nodes = h.connect(bs, h.Weights())
    assert cost(nodes, h.cut(nodes)) == pytest.approx(least(nodes))


def test_short_lines_follow_what_is_around_them():
    bs = h.blocks(f"<article><h1>A title of it</h1><p>{LINE}</p><p>Er the.</p><p>{LINE}</p></article><div class=ad><p>{LINE}</p></div><footer>Er the.</footer>")
    h.classify(bs, h.Weights())
    assert [b.score > 0 for b in bs] == [False, True, False, True, False, False]
    assert h.cut(h.connect(bs, h.Weights()))[: len(bs)] == [True, True, True, True, False, False]


def test_without_an_article_element():
    page = f"<body><div><div>{LINE}</div><p>{LINE}</p><p>Er.</p><p>{LINE}</p></div><ul>" + "<li><a href=x>Some link</a>" * 5 + "</ul>"
    assert h.extract(page)[0] == "\n".join((LINE, LINE, "Er.", LINE))


def test_links_do_not_take_an_article_along():
    links = "<li><a href=x>link</a>" * 20
    assert h.extract(f"<article><p>{LINE}</p><ul>{links}</ul></article>")[0] == LINE
    assert h.extract(f"<article><ul>{links}</ul></article><p>{LINE}</p>")[0] == LINE


def test_long_page_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    page = "<article>" + f"<p>{LINE}</p><p>Er.</p>" * 30_000 + "</article>"
    d = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "u", None)], "page_id long, url string, html string").withColumn("n_blocks", F.lit("x")).withColumn("n_content", F.lit("y"))
    got = h.extract_pages(d).collect()
    assert [r.n_content for r in got] == [60_000, 60_000, 0] and all(r.n_chars == len(r.text) for r in got)
