"""Similarity of vectors: top-k search, exact neighbour graph by blocks, mutual neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.operators.components import stored


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def _block_pairs(vectors: DataFrame, block: int, key: str, vec: str, tag: str | None = None, once: bool = False) -> DataFrame:
    """(b, ib, tb, vb, c, ic, tc, vc): pairs of blocks of ids, tags and vectors as bytes, in tasks where each b is followed by all its c.

    Blocks are written once and each task reads its two ranges of them, so pairs
    of blocks are never shuffled. With ``once`` a pair of blocks meets in one order only.
    """
    of = vectors.schema[vec].dataType.elementType.simpleString()
    kind = np.float32 if of == "float" else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            i, g, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at = np.argsort(i, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([x[at].tobytes()], pa.binary()) for x in (i, g, v)], ["ids", "tags", "vecs"])

        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                ids, tags = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                held.append([ids, tags, np.stack(part.column(2).to_numpy(zero_copy_only=False)).astype(kind)])
                if sum(len(x[0]) for x in held) >= block:
                    yield emit()
        if held:
            yield emit()

    rows = vectors.select(F.col(key).cast("long").alias("i"), (F.lit(0) if tag is None else F.col(tag)).cast("long").alias("t"), F.col(vec).cast("array<float>" if kind is np.float32 else "array<double>").alias("v")).where("i IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL")
    packed = stored(rows.mapInArrow(pack, "ids binary, tags binary, vecs binary").withColumn("b", F.monotonically_increasing_id()))
    n, size = packed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vecs")), F.lit(0))).first()
    # what a task reads for each of its blocks is held at once: 64 MB
    left = packed.select("b", F.col("ids").alias("ib"), F.col("tags").alias("tb"), F.col("vecs").alias("vb")).repartition(max(1, min(n, 64 + n // 16)))
    right = packed.select(F.col("b").alias("c"), F.col("ids").alias("ic"), F.col("tags").alias("tc"), F.col("vecs").alias("vc")).repartition(max(1, -(-size // (64 << 20))))
    return left.hint("shuffle_replicate_nl").join(right, F.col("b") <= F.col("c") if once else F.lit(True))


def _unpacked(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple]:
    """(b, ids, tags, vectors, c, ids, tags, vectors) of each pair of blocks."""
    last, own = None, ()
    for batch in batches:
        for b, ib, tb, vb, c, ic, tc, vc in zip(*batch.columns, strict=True):
            if last != (last := b.as_py()):
                own = tuple(np.frombuffer(x.as_buffer(), y) for x, y in ((ib, np.int64), (tb, np.int64), (vb, kind)))
            ids, tags, v = (np.frombuffer(x.as_buffer(), y) for x, y in ((ic, np.int64), (tc, np.int64), (vc, kind)))
            yield last, own[0], own[1], own[2].reshape(len(own[0]), -1), c.as_py(), ids, tags, v.reshape(len(ids), -1)


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of all rows of a and b in single precision, and by how much those of each row of a can be off; in double where single could overflow."""
    x, y = (np.sqrt(np.einsum("ij,ij->i", z, z, dtype=np.float64)) for z in (a, b))
    most = y.max(initial=0)
    if not x.max(initial=0) * most < 1e30 or not max(x.max(initial=0), most) < 1e30:
        return a.astype(np.float64) @ b.astype(np.float64).T, (a.shape[1] + 8) * 2.0**-52 * x * most
    # rounding of the numbers, of each product and of their sum, and of a bound that is compared
    off = (a.shape[1] + 8) * 2.0**-23 * x * most + 1e-30
    return a.astype(np.float32) @ b.astype(np.float32).T, off


def _reached(s: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where s is at its row's floor or above; most rows have none and are passed over."""
    rows = np.flatnonzero(s.max(axis=1, initial=-np.inf) >= floor)
    p, q = np.divmod(np.flatnonzero(s[rows] >= floor[rows, None]), s.shape[1])
    return rows[p], q


def _exact(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of the rows p of a with the rows q of b in double precision."""
    out = np.empty(len(p))
    for lo in range(0, len(p), 1 << 15):
        out[lo : lo + (1 << 15)] = np.einsum("ij,ij->i", a[p[lo : lo + (1 << 15)]], b[q[lo : lo + (1 << 15)]], dtype=np.float64)
    return out


class _Nearest:
    """The k best others so far of each row of a block: the largest products at 12 decimals, of equal ones the lower ids."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.floor = np.full(len(ids), -np.inf)
        self.p, self.j, self.sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        for lo in range(0, len(self.ids), 256):
            hi = min(lo + 256, len(self.ids))
            s, off = _products(self.vecs[lo:hi], vecs)
            at = np.searchsorted(ids, self.ids[lo:hi])
            if (ids[np.minimum(at, len(ids) - 1)] == self.ids[lo:hi]).any():
                s[self.ids[lo:hi, None] == ids[None, :]] = -np.inf
            if np.isneginf(self.floor[lo:hi]).any() and len(ids) > self.k:
                self.floor[lo:hi] = np.maximum(self.floor[lo:hi], np.partition(s, -self.k, axis=1)[:, -self.k].astype(np.float64) - off - 2e-12)
            p, q = _reached(s, (self.floor[lo:hi] - off).astype(s.dtype))
            ok = np.isfinite(s[p, q])
            p, q = p[ok] + lo, q[ok]
            sim = _exact(self.vecs, vecs, p, q)
            ok = (sim >= self.floor[p]) & np.isfinite(sim)
            self.more.append((p[ok], ids[q[ok]], sim[ok]))
        if sum(len(x[0]) for x in self.more) >= self.k * len(self.ids):
            self.settle()

    def settle(self) -> None:
        p, j, sim = (np.concatenate([x, *y]) for x, y in zip((self.p, self.j, self.sim), zip(*self.more, strict=True) if self.more else ((), (), ()), strict=True))
        self.more.clear()
        order = np.lexsort((j, -np.round(sim, 12), p))
        p, j, sim = p[order], j[order], sim[order]
        rank = np.arange(len(p)) - np.searchsorted(p, p)
        last = rank == self.k - 1
        self.floor[p[last]] = np.round(sim[last], 12) - 1e-12
        keep = rank < self.k
        self.p, self.j, self.sim = p[keep], j[keep], sim[keep]


def knn(vectors: DataFrame, k: int = 10, block: int = 2048, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(i, j, sim, rank): the k most similar others of every vector, exactly; ties go to the lower id.

    Vectors are packed into blocks of bytes where they are read. A block meets
    all blocks of a range in one task, by products in single precision; what
    they can't rule out by their error bound is computed in double. Only k
    candidates of each vector and range are shuffled. The work is quadratic in
    the vectors.
    """
    kind = np.float32 if vectors.schema[vec].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, near = None, None

        def found() -> Iterator[pa.RecordBatch]:
            if near is not None:
                near.settle()
                yield pa.RecordBatch.from_arrays([pa.array(near.ids[near.p]), pa.array(near.j), pa.array(near.sim)], ["i", "j", "sim"])

        for b, ids, _, v, _, others, _, w in _unpacked(batches, kind):
            if b != last:
                yield from found()
                last, near = b, _Nearest(ids, v, k)
            near.meet(others, w)
        yield from found()

    near = _block_pairs(vectors, block, key, vec).mapInArrow(run, "i long, j long, sim double")
    w = Window.partitionBy("i").orderBy(F.desc(F.round("sim", 12)), "j")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(vectors: DataFrame, threshold: float, block: int = 2048, key: str = "vec_id", vec: str = "embedding", tag: str | None = None) -> DataFrame:
    """(i, j, sim) with i < j of all pairs of unit vectors at ``threshold`` or more, exactly; blocks meet as in ``knn``. With ``tag``, a column, only pairs of equal tags."""
    kind = np.float32 if vectors.schema[vec].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, g, v, c, y, h, w in _unpacked(batches, kind):
            for lo in range(0, len(x), 256):
                s, off = _products(v[lo : lo + 256], w)
                p, q = _reached(s, (threshold - off).astype(s.dtype))
                ok = (g[lo:][p] == h[q]) & (x[lo:][p] < y[q] if b == c else x[lo:][p] != y[q])
                p, q = p[ok], q[ok]
                sim = _exact(v[lo : lo + 256], w, p, q)
                ok = sim >= threshold
                i, j = x[lo:][p[ok]], y[q[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(sim[ok])], ["i", "j", "sim"])

    return _block_pairs(vectors, block, key, vec, tag, once=True).mapInArrow(run, "i long, j long, sim double")


def mutual(edges: DataFrame, threshold: float) -> DataFrame:
    """(i, j, sim) with i < j of edges that go both ways and are similar enough; edges are stored, as they are read twice."""
    edges = stored(edges.select("i", "j", "sim").where(F.col("sim") >= threshold))
    back = edges.select(F.col("i").alias("j"), F.col("j").alias("i"))
    return edges.join(back, ["i", "j"], "left_semi").where("i < j").select("i", "j", "sim")


def medoids(vectors: DataFrame, group: str, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(group, size, medoid): the member closest to the normalised sum; ties go to the first."""
    flat = vectors.select(group, key, F.posexplode(F.col(vec).cast("array<double>")).alias("d", "x"))
    centre = flat.groupBy(group, "d").agg(F.sum("x").alias("x")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))
    # a row for each group, as long as a vector
    scored = vectors.select(group, key, vec).join(centre, group).withColumn("sim", F.round(dot(vec, "c") / F.when(norm("c") > 0, norm("c")).otherwise(F.lit(1.0)), 12))
    return scored.groupBy(group).agg(F.count("*").alias("size"), F.max_by(key, F.struct("sim", -F.col(key))).alias("medoid"))


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns scaled to -1..1 over all rows; a column without span gives 0."""
    ends = df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(ends))  # one row
    for c in cols:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        out = out.withColumn(c, F.when(span > 0, (F.col(c) - F.col(f"lo_{c}")) / span * 2 - 1).otherwise(F.lit(0.0)))
    return out.drop(*ends.columns)
