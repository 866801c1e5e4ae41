"""Predicates of one meaning folded: near pairs of one voice, mutual entailment, average linkage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import kg, vectors
from corpusflow.operators.layout import average_linkage
from corpusflow.protocols import EntailmentScorer, TermEntailment

#: What a predicate stands between when its entailment is judged.
FRAMES = (("X", "Y"), ("the method", "the dataset"))


def candidate_pairs(predicates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b, sim) with a < b of predicates (id, predicate, vec) at ``threshold`` or more, of the same voice."""
    # pairs are of one voice where they are made, so they are never joined
    voiced = predicates.select("id", "vec", T.is_inverse_voice("predicate").alias("voice"))
    return vectors.within(voiced, threshold, key="id", vec="vec", tag="voice").select(F.col("i").alias("a"), F.col("j").alias("b"), "sim")


def entailed_pairs(pairs: DataFrame, predicates: DataFrame, scorer: EntailmentScorer = TermEntailment(), floor: float = 0.5) -> DataFrame:
    """Pairs (a, b) of predicates that entail each other both ways in every frame; a later frame sees only what is left."""
    p = predicates.select("id", "predicate")
    left = pairs.select("a", "b").join(p.withColumnsRenamed({"id": "a", "predicate": "pa"}), "a").join(p.withColumnsRenamed({"id": "b", "predicate": "pb"}), "b")
    for subject, other in FRAMES:
        framed = lambda c: F.concat(F.lit(f"{subject} "), F.col(c), F.lit(f" {other}."))  # noqa: B023, E731
        left = left.where((scorer.entails(framed("pa"), framed("pb")) >= floor) & (scorer.entails(framed("pb"), framed("pa")) >= floor))
    return left.select("a", "b")


def merge_map(triples: DataFrame, predicates: DataFrame, pairs: DataFrame, cut: float = 0.5) -> DataFrame:
    """(member, rep) of groups of predicates by average linkage of approved pairs; the most used, shortest, first one stands for all.

    Only predicates of some pair are gathered: the vocabulary of a graph, some thousands.
    """
    spark = triples.sparkSession
    approved = [(r.a, r.b) for r in pairs.collect()]
    ids = sorted({x for p in approved for x in p})
    if not ids:
        return spark.createDataFrame([], "member string, rep string")
    at = {x: k for k, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b in approved:
        m[at[a], at[b]] = m[at[b], at[a]] = 1
    groups = [(ids[k], g) for g, xs in enumerate(average_linkage(m, cut)) for k in xs if len(xs) > 1]
    used = triples.select("s", "p", "o").distinct().groupBy("p").agg(F.count("*").alias("n")).withColumnRenamed("p", "predicate")
    named = spark.createDataFrame(groups, "id long, g long").join(predicates.select("id", "predicate"), "id").join(used, "predicate", "left").fillna(0, ["n"])
    reps = named.groupBy("g").agg(F.min_by("predicate", F.struct(-F.col("n"), F.length("predicate"), "predicate")).alias("rep"))
    return named.join(reps, "g").select(F.col("predicate").alias("member"), "rep")


def normalise(triples: DataFrame, predicates: DataFrame, threshold: float = 0.75, scorer: EntailmentScorer = TermEntailment()) -> DataFrame:
    """Triples with predicates of one meaning under one name."""
    merged = merge_map(triples, predicates, entailed_pairs(candidate_pairs(predicates, threshold), predicates, scorer))
    none = triples.sparkSession.createDataFrame([], "member string, rep string")
    return kg.apply_merge(triples, none, merged)
