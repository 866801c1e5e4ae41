"""Decontamination against all item-sized windows."""

import random
from collections import Counter

import pytest

from corpusflow.llm import decontaminate


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def best(doc, item):
    own, n = bag(item), len(item)
    return max((x := bag(doc[s : s + n]), sum((x & own).values()) / sum((x | own).values()))[1] for s in range(max(1, len(doc) - n + 1)))


@pytest.mark.parametrize("bound", [10**6, 0])
def test_best_window_lies_between_alignments(spark, bound):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(59)]
    docs = {0: ["a", *item[1:31], "new1", "new2", *item[31:58], "b"]}
    items = {0: item} | {k: [f"v{k}x{i}" for i in range(rng.randint(30, 59))] for k in range(1, 6)}
    for d in range(1, 250):
        w = list(items[rng.randrange(6)])
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 2)] = [f"e{rng.random()}"[:6].replace(".", "") for _ in range(rng.randint(0, 2))]
        if d % 5 == 0:
            k = rng.randrange(len(w))
            w = w[k:] + w[:k]
        docs[d] = [f"l{i}" for i in range(rng.randint(0, 3))] + w + [f"r{i}" for i in range(rng.randint(0, 3))]
    want = {(d, k): round(x, 6) for d, w in docs.items() for k, v in items.items() if (x := best(w, v)) >= 0.8}
    assert want[0, 0] == round(49 / 61, 6)
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame, bench, decontaminate.Settings(broadcast_shingles=bound)).collect()}
    assert got == want
