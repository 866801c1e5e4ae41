import numpy as np

from corpusflow.operators import layout, names


def test_named_documents(spark):
    docs = spark.createDataFrame([(1, "1.1 Dermal_sens.pdf", None), (2, "1.10_Dermal_sens.pdf", None), (3, "ab.pdf", "A long title about dermal sensitisation"), (4, "2 Oral.pdf", "short")], "doc_id int, filename string, title string")
    index = names.document_index(docs)
    ask = lambda q: sorted(r.doc_id for r in names.named_documents(index, q).collect())
    assert ask("what does 1.10 say on dermal effects") == [2]
    assert ask("see 1.1 dermal sens and a long title about dermal sensitisation") == [1, 3]
    assert ask("dermal") == ask("") == []
    assert ask("1.1 dermal, 1.10 dermal, 2 oral") == []


def test_seeds(spark):
    n = spark.createDataFrame([("Random Forest",), ("forest",), ("CO",), ("model",)], "name string")
    a = spark.createDataFrame([("RF", "Random Forest"), ("model", "forest"), ("gone", "missing")], "member string, rep string")
    got = names.match_seeds("is random forest a model of CO or co, or RF gone", n, a)
    assert [(s.entity, s.first, s.words) for s in got] == [("Random Forest", 1, 2), ("model", 4, 1), ("CO", 6, 1), ("Random Forest", 10, 1)]
    assert names.match_seeds("", n) == []


def test_definitions(spark):
    d = spark.createDataFrame([("We use a convolutional neural network (CNN) and scanning electron microscopy (SEM) here (see).",), (None,)], "text string")
    assert sorted(tuple(r) for r in names.definitions(d).collect()) == [("CNN", "convolutional neural network", 1), ("SEM", "scanning electron microscopy", 1)]


def test_layout(spark):
    p = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float)
    assert set(layout.hull(p).tolist()) == {0, 1, 2, 3}
    assert sum(np.linalg.norm(p[a] - p[b]) for a, b in layout.spanning_tree(p)) < 7.5 and len(layout.spanning_tree(p)) == 5
    df = spark.createDataFrame([(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(p)], "vec_id long, g int, x double, y double")
    assert layout.hulls(df, "g").count() == 5  # three points of one group lie on a line
    assert layout.average_linkage(np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]])) == [[0, 1], [2]]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.random.default_rng(0).normal(size=(9, 5)))], "vec_id long, embedding array<double>")
    assert {len(r.p) for r in layout.project(v, 2).collect()} == {2}
