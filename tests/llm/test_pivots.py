"""Links found by pivot coordinates against all pairs, with groups of many sizes."""

import numpy as np
import pytest

from corpusflow.llm import simhash_dedup as x


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_lose_no_pair(spark, radius):
    rng = np.random.default_rng(radius)
    one = lambda n: np.uint64(1) << rng.integers(0, 64, n, np.uint64)
    base = rng.integers(0, 1 << 63, 40, np.uint64)[rng.integers(0, 40, 1500) // rng.integers(1, 9, 1500)]
    fp = np.unique(base ^ one(1500) ^ np.where(rng.random(1500) < 0.5, one(1500), 0).astype(np.uint64))
    s = x.Settings(radius=radius, direct=64)
    rows = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    got = [(r.a, r.b) for r in x.links(rows, s).collect()]

    def groups(pairs):
        up = {int(v): int(v) for v in fp.view(np.int64)}

        def root(a):
            while up[a] != a:
                a = up[a]
            return a

        for a, b in pairs:
            up[root(a)] = root(b)
        sets = {}
        for v in up:
            sets.setdefault(root(v), set()).add(v)
        return sorted(map(sorted, sets.values()))

    signed = fp.view(np.int64)
    every = [(int(signed[a]), int(signed[b])) for a in range(len(fp)) for b in np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= radius) + a + 1]
    assert every and groups(got) == groups(every)
    assert all(int(np.bitwise_count(np.array([a ^ b], np.int64).view(np.uint64))[0]) <= radius for a, b in got)


def test_parts_cover_each_bit_once():
    m = x.parts(x.Settings())
    assert len(m) == 4 and sum(m) == (1 << 64) - 1


def test_coordinates_differ_by_no_more_than_bits():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 500), np.uint64)
    s = x.Settings()
    for m in x.parts(s):
        gap = np.abs(x.distances(a, x.pivot_set(s), [m]) - x.distances(b, x.pivot_set(s), [m])).max(0)
        assert (gap <= np.bitwise_count((a ^ b) & np.uint64(m))).all()
