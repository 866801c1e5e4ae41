"""SimHash near-duplicates with pivot distance tables.

Fingerprints of 3-word shingles link at ``radius`` or fewer differing bits.
Only distinct fingerprints are compared. A table holds every fingerprint's
Hamming distances to ``pivots`` reference fingerprints, taken for each of
``radius + 2`` parts of the fingerprint. By the triangle inequality a
coordinate of two linked fingerprints differs by no more bits than the part
does, so all coordinates of at least two parts are equal: rows of the table
meet where the coordinates of a pair of parts are. Of those that meet, a pair
is discarded where any coordinate, of a part or the sum of all, differs by more
than the radius, and the survivors are verified. Large groups are first cut
along the distances to whole pivots, in overlapping strips as wide as the
radius, so work follows the pairs that are near. A group gives a forest of its
links, never all pairs; copies of a fingerprint meet only in aggregates and in
a join that can be split.

Cells of distances to whole fingerprints as keys would be exact too, but a
pivot tells random fingerprints apart by about one bit and then puts a fifth of
them into two cells: 2 ** 24 cells need some 70 rows for each fingerprint, where
pairs of parts need six, however many there are.

Null and empty texts have fingerprint zero and link like any other; repeated
rows keep their fingerprint and component; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import cut
from corpusflow.operators.components import components


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    radius: int = 2
    pivots: int = 16
    seed: int = 5
    #: groups up to this size are compared directly, larger ones are cut by pivots first
    direct: int = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit majority of the shingles' XXH64 (seed 42)."""
    joined = b" ".join(words := (text or "").encode("utf-8", "replace").lower().split())
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= shingle:
        return int(np.array(xxhash.xxh64_intdigest(joined, 42), np.uint64).view(np.int64))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([fingerprint(t, s.shingle) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, fp long")


def pivot_set(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(0, 1 << 63, s.pivots, np.uint64) * np.uint64(2) + np.arange(s.pivots, dtype=np.uint64) % np.uint64(2)


def parts(s: Settings) -> list[int]:
    """Masks of the parts of a fingerprint: every so many bits, so that parts are even whatever bits texts share."""
    n = s.radius + 2
    return [sum(1 << k for k in range(64) if k % n == i) for i in range(n)]


def distances(fp: np.ndarray, pivots: np.ndarray, masks: list[int] = [(1 << 64) - 1]) -> np.ndarray:  # noqa: B006
    """The pivot table, a row for each pivot and part."""
    return np.concatenate([np.bitwise_count((fp[None, :] ^ pivots[:, None]) & np.uint64(m)).astype(np.int8) for m in masks])


def _verify(fp: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j), those within the radius: first by the largest coordinate difference, then exactly."""
    for row in d:
        ok = np.abs(row[i] - row[j]) <= radius
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[ok], j[ok]


def near_pairs(fp: np.ndarray, d: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius among distinct fingerprints, some of them more than once."""
    todo = [(np.arange(len(fp)), 0)]
    while todo:
        own, k = todo.pop()
        if len(own) > s.direct and k < len(d):
            strip = d[k][own] // (s.radius + 1)
            cells = np.unique(strip)
            for c in cells:  # a pair lies in one strip or in two neighbours
                part = own[(strip == c) | (strip == c + 1)]
                todo.append((part, k + 1))
            continue
        order = own[np.argsort(d[0][own], kind="stable")]
        x = d[0][order].astype(np.int16)
        upto = np.searchsorted(x, x + s.radius, "right")
        for at in range(0, len(order), 256):
            n = upto[at : at + 256] - np.arange(at, min(at + 256, len(order))) - 1
            i = np.repeat(np.arange(at, at + len(n)), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            yield _verify(fp, d, order[i], order[j], s.radius)


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if (ra := root(a)) != (rb := root(b)):
                up[ra] = rb
                out.append((a, b))
    return out


def _links(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys of sorted rows (t, key, fp)."""
    pivots, masks = pivot_set(s), parts(s)
    rest = [np.empty(0, np.int64)] * 3

    def linked(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u = fp.view(np.uint64)
        own = distances(u, pivots, masks)
        edge = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True]])) if len(t) else np.zeros(1, np.int64)
        size = np.diff(edge)
        d = np.concatenate([own.reshape(len(masks), len(pivots), -1).sum(0, dtype=np.int8), own])
        a, b = [], []
        run = np.repeat(np.arange(len(size)), size)
        small = (size <= 16)[run] if len(size) else np.empty(0, bool)
        for o in range(1, 16):
            i = np.flatnonzero((run[o:] == run[:-o]) & small[o:]) if len(run) > o else np.empty(0, np.int64)
            if not len(i):
                break
            i, j = _verify(u, d, i, i + o, s.radius)
            a.append(fp[i])
            b.append(fp[j])
        for k in np.flatnonzero(size > 16):
            lo, hi = edge[k], edge[k + 1]
            found = _forest(near_pairs(u[lo:hi], d[:, lo:hi], s))
            if found:
                i, j = np.array(found).T
                a.append(fp[lo:hi][i])
                b.append(fp[lo:hi][j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, batch.columns, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]  # the last run may go on
        yield linked(*(c[:last] for c in cols))
        rest = [c[last:] for c in cols]
    yield linked(*rest)


def links(fps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b): links whose transitive closure is that of all pairs of distinct fingerprints ``fp`` within the radius."""
    pivots, masks = ([x - (1 << 64) if x >> 63 else x for x in xs] for xs in (pivot_set(s).tolist(), parts(s)))
    coordinates = [F.array(*(F.bit_count(F.col("fp").bitwiseXOR(p).bitwiseAND(m)) for p in pivots)) for m in masks]
    table = fps.select("fp", F.array(*coordinates).alias("d"))
    tables = [F.struct(F.lit(k).cast("long").alias("t"), F.xxhash64(F.col("d")[i], F.col("d")[j]).alias("key"), "fp") for k, (i, j) in enumerate(combinations(range(len(masks)), 2))]
    rows = table.select(F.explode(F.array(*tables)).alias("x")).select("x.*")
    count = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(count, "t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(lambda b: _links(b, s), "a long, b long")


def dedup(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    own = cut(fingerprints(docs, s, text))
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(own.select("fp").distinct(), s))
    joined = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
