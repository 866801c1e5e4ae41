"""Percentiles of large groups and fractional values."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import rank
from corpusflow.plans import catalogue

DIR = "/root/testdata/sf0.01"


def test_prices_as_in_sql(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    duckdb.sql(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{DIR}/lineitem.parquet'")
    want = duckdb.sql(catalogue.ORACLES["percentile_ties"])
    assert want.columns == ["l_returnflag", "l_extendedprice", "c", "pct"]
    assert sorted(want.fetchall()) == sorted(map(tuple, catalogue.QUERIES["percentile_ties"](spark, DIR).collect()))


def test_group_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 4000) / 7) for g, n in ((None, 5000), ("a", 20000), ("b", 1)) for _ in range(n)]
    out = rank.percentile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    got = {(r.g, r.v): (r.c, round(r.pct, 9)) for r in out.collect()}
    for g in (None, "a", "b"):
        own = sorted(math.floor(v * 1e12 + 0.5) / 1e12 for k, v in rows if k == g)
        first, count = {}, {}
        for i, v in enumerate(own):
            first.setdefault(v, i)
            count[v] = count.get(v, 0) + 1
        want = {v: (c, round((first[v] + (c - 1) / 2) / (len(own) - 1), 9) if len(own) > 1 else 1.0) for v, c in count.items()}
        assert {v: x for (k, v), x in got.items() if k == g} == want


def test_values_that_change_when_computed_anew(spark):
    """Sums can round to another value in each execution; every row keeps its percentile."""
    unstable = F.udf(lambda _: random.random(), "double").asNondeterministic()
    rows = spark.range(40).withColumn("g", F.lit(None).cast("string")).withColumn("v", unstable("id"))
    got = sorted(rank.with_percentile(rows, ["g"], "v", "pct").collect(), key=lambda r: r.v)
    assert [round(r.pct * 39) for r in got] == list(range(40))
