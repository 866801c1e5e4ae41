"""Best matches by vectors: missing entities and reworded claims."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import grounding, kg, predicates, vectors


def test_missing_names_nearest(spark):
    s = "name string, vec array<double>"
    a = spark.createDataFrame([("same", [0.0, 1.0]), ("near", [1.0, 0.1]), ("far", [1.0, 1.0]), ("off", [-1.0, 0.0])], s)
    b = spark.createDataFrame([("same", [-5.0, 5.0]), ("Near", [2.0, 0.0]), ("tie", [0.0, 3.0])], s)
    for block in (2048, 1):
        got = {r.name: (r.nearest, round(r.similarity, 6)) for r in kg.missing(a, b, block=block).collect()}
        assert got == {"far": ("Near", 0.707107), "off": ("same", 0.707107)}
    assert {(r.nearest, r.similarity) for r in kg.missing(a, b.limit(0)).collect()} == {(None, -1.0)}


def test_reworded_claims(spark):
    chunks = spark.createDataFrame([(1, 7, "alpha beta gamma delta epsilon", [1.0, 0.0]), (1, 8, "zeta theta iota kappa lambda", [0.0, 1.0])], "key int, chunk_id int, chunk string, vec array<double>")
    claims = spark.createDataFrame(
        [
            (1, 1, "reworded words about other greek letters", False, [0.1, 1.0]),
            (2, 1, "reworded words about other greek letters", True, [0.1, 1.0]),
            (3, 1, "nothing close said here anywhere today", False, [-1.0, -0.5]),
            (4, 1, "alpha beta gamma delta", False, [0.0, 1.0]),
            (5, 1, "short claim", False, [1.0, 0.0]),
        ],
        "claim_id int, key int, claim string, quoted boolean, vec array<double>",
    )
    got = {r.claim_id: (r.chunk_id, r.verified) for r in grounding.verify(claims, chunks).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {1: (8, True), 4: (7, True), 5: (7, True)}
    assert not got[2][1] and not got[3][1]


def _plans(df) -> str:
    return df._jdf.queryExecution().toString()


def test_neighbours_of_blocks_in_any_order(spark):
    """Single precision only narrows: ties, equal vectors, close ones and large ones come out as by brute force in double."""
    r = np.random.default_rng(4)
    for kind, scale in (("float", 1.0), ("double", 1.0), ("double", 1e20)):
        v = r.normal(size=(150, 6)).round(1)
        v[40:60] = v[40]
        v[60:80] = v[40] * (1 + 1e-9 * np.arange(20)[:, None])
        v = (v * scale).astype(np.float32 if kind == "float" else np.float64)
        df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"vec_id long, embedding array<{kind}>").repartition(3)
        s = np.round(v.astype(float) @ v.astype(float).T, 12)
        want = {i: sorted((j for j in range(150) if j != i), key=lambda j: (-s[i, j], j))[:5] for i in range(150)}  # noqa: B023
        for block in (7, 2048):
            got: dict[int, list[int]] = {}
            for x in vectors.knn(df, 5, block=block).orderBy("i", "rank").collect():
                got.setdefault(x.i, []).append(x.j)
            assert all(np.allclose(s[i, got[i]], s[i, want[i]], rtol=1e-12, atol=1e-12) for i in want)
            assert scale != 1.0 or got == want
            t = 2.003 * scale**2
            pairs = [(x.i, x.j) for x in vectors.within(df, t, block=block).collect()]
            assert sorted(pairs) == [(i, j) for i in range(150) for j in range(i + 1, 150) if float(v[i].astype(float) @ v[j].astype(float)) >= t]


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Neither pairs of blocks nor pairs of vectors are dealt out anew, and the search of mutual neighbours runs once."""
    df = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(60)], "vec_id long, embedding array<float>")
    plan = _plans(vectors.within(df, 0.5, block=8))
    assert "CartesianProduct" in plan and "Join" not in plan.split("== Physical Plan ==")[1]
    p = df.select(F.col("vec_id").alias("id"), F.lit("makes").alias("predicate"), F.col("embedding").alias("vec"))
    physical = _plans(predicates.candidate_pairs(p, 0.5)).split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in physical and "BroadcastHashJoin" not in physical
    assert "MapInArrow" not in _plans(vectors.mutual(vectors.knn(df, 3, block=8), 0.5)).split("== Physical Plan ==")[1]
