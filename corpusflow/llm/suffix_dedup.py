"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every byte covered by a string of ``depth`` bytes that also starts elsewhere is
removed. Suffixes need to be told apart through ``depth`` bytes only, so they
are ordered by most-significant-digit passes that stop there:

1. The first digit of a window is its smallest ``gram``-byte hash, the anchor:
   equal windows have equal anchors at equal offsets, so one row for each
   anchor (about two in ``depth`` bytes) stands for all windows around it.
   Anchors that occur once are settled: no window around them comes back.
2. The next digit is the hash of all that windows around an anchor can reach,
   its context. Where a context comes back, all its windows do.
3. Only contexts that differ within a bucket of equal anchors go on, one of
   each kind. Sorted outwards from the anchor, right sides and left sides give
   the depth to which they agree; windows in equal groups at their full depth
   are exactly the repeated ones. Buckets of over ``bucket`` contexts are not
   gathered: there the bytes that windows of a range of offsets share are the
   next digit, and then each window that is left is a digit of its own.

Counts are combined before every shuffle, and joins on anchors can be split.
Copies of a text share one key, the text's hash and length, and one list of spans.
Null and empty texts and texts below ``depth`` bytes keep all they have;
repeated rows are copies of each other; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import stored


@dataclass(frozen=True)
class Settings:
    depth: int = 400
    #: long enough that other texts seldom share an anchor without sharing more
    gram: int = 64
    #: contexts of a bucket that one task gathers at most
    bucket: int = 20_000
    #: offsets of a range, by which larger buckets are told apart before their windows are
    range: int = 48
    #: bytes of a text that are searched for anchors at once (at most 2**20); pieces overlap
    piece: int = 1 << 20

    @property
    def reach(self) -> int:
        """Largest offset of an anchor in its window."""
        return self.depth - self.gram


_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 15), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def anchors(b: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows' anchors (leftmost smallest gram hash) and their 32-bit digits."""
    n, w, k = len(b), s.reach + 1, s.gram
    if n < s.depth:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_P, n))])
    h = (total[k:] - total[:-k]) * _power(_PINV, n)[: n - k + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    m = len(h)
    key = h & ~np.uint64((1 << 20) - 1) | np.arange(m, dtype=np.uint64)
    rows = -(-m // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[:m] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    at = least[np.concatenate([[True], least[1:] != least[:-1]])] & np.uint64((1 << 20) - 1)
    at = np.unique(at).astype(np.int64)
    return at, (h[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _anchor_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    names = ["ah", "ch", "doc_id", "th", "size", "p"]
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            out: list[list] = [[] for _ in names]
            ctx: list[int] = []
            for doc, text, th in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                n = len(raw)
                found = [(start, *anchors(np.frombuffer(raw[start : start + s.piece], np.uint8), s)) for start in range(0, max(n - s.depth + 1, 0), s.piece - s.depth + 1)]
                if not found:
                    continue
                # neighbouring pieces can share an anchor
                at, one = np.unique(np.concatenate([start + at for start, at, _ in found]), return_index=True)
                ctx.extend(digest(raw[max(0, p - s.reach) : p + s.depth], min(p, s.reach)) for p in at.tolist())
                out[0].append(np.concatenate([ah for _, _, ah in found])[one])
                out[2].append(np.full(len(at), -1 if doc is None else doc, np.int64))
                out[3].append(np.full(len(at), th, np.int64))
                out[4].append(np.full(len(at), n, np.int32))
                out[5].append(at.astype(np.int32))
            if ctx:
                cols = [pa.array(np.concatenate(x)) if x else None for x in out]
                cols[1] = pa.array(np.array(ctx, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(cols, names)


def _same(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def repeated(contexts: list[tuple[bytes, int]], s: Settings) -> list[list[tuple[int, int]]]:
    """For each context (bytes, anchor's offset) the spans around its anchor that windows repeated in another context cover."""
    g = len(contexts)
    right = [c[left:] for c, left in contexts]
    back = [c[:left][::-1] for c, left in contexts]
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if g <= 16:
        for i in range(g):
            for j in range(i):
                r = _same(right[i], right[j])
                if r >= s.gram and (b := _same(back[i], back[j])) + r >= s.depth:
                    out[i].append((-b, r))
                    out[j].append((-b, r))
        return out

    def groups(sides: list[bytes], depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of every side at every depth, and whether it reaches it."""
        order = sorted(range(g), key=sides.__getitem__)
        lcp = np.array([0, *(_same(sides[a], sides[b]) for a, b in zip(order, order[1:], strict=False))])
        number = np.empty((len(depths), g), np.int64)
        number[:, order] = np.cumsum(lcp[None, :] < depths[:, None], 1)
        return number, np.array([len(x) for x in sides])[None, :] >= depths[:, None]

    offs = np.arange(s.reach + 1)
    lg, lok = groups(back, offs)
    rg, rok = groups(right, s.depth - offs)
    hit = np.zeros((len(offs), g), bool)
    for o in offs:
        own = np.flatnonzero(lok[o] & rok[o])
        _, inv, count = np.unique(lg[o, own] * (g + 1) + rg[o, own], return_inverse=True, return_counts=True)
        hit[o, own] = count[inv] > 1
    for i in range(g):
        on = np.flatnonzero(np.diff(np.concatenate([[0], hit[:, i].astype(np.int8), [0]])))
        out[i] = [(-int(b) + 1, s.depth - int(a)) for a, b in zip(on[::2], on[1::2], strict=True)]
    return out


def _bucket_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Spans (ah, ch, a, b) from runs of equal anchors of sorted rows (ah, ch, left, n, ctx)."""
    run: list[tuple] = []
    rows: list[tuple[int, int, int, int]] = []

    def close() -> None:
        for (_, ch, _, n, _), spans in zip(run, repeated([(x[4], x[2]) for x in run], s), strict=True):
            if n == 1 and spans:  # where a context itself comes back, all of it is known to
                # every span holds the anchor, so together they are one
                rows.append((run[0][0], ch, min(a for a, _ in spans), max(b for _, b in spans)))
        run.clear()

    def emit() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["ah", "ch", "a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and run[0][0] != row[0]:
                close()
            if not run or run[-1][1] != row[1]:
                run.append(row)
        if len(rows) > 20_000:
            yield emit()
    if run:
        close()
    yield emit()


def _ranges(s: Settings) -> list[tuple[int, int]]:
    """Ranges of an anchor's offset in its window, first and last."""
    return [(lo, min(lo + s.range, s.reach + 1) - 1) for lo in range(0, s.reach + 1, s.range)]


def _core_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """For each range of offsets the bytes that all its windows share, as a digit: (ah, ch, n, r, w)."""
    for batch in batches:
        rows = []
        for ah, ch, left, n, ctx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for r, (lo, hi) in enumerate(_ranges(s)):
                if lo <= left and left + s.depth - hi <= len(ctx):
                    w = xxhash.xxh3_64_intdigest(ctx[left - lo : left + s.depth - hi])
                    rows.append((ah, ch, n, r, w - (1 << 64) if w >> 63 else w))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["ah", "ch", "n", "r", "w"])


def _window_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Every window of a context in ranges rs as a digit: (ah, ch, n, o, w)."""
    ranges = _ranges(s)
    for batch in batches:
        for ah, ch, left, n, ctx, rs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            offs = [o for r in rs for o in range(ranges[r][0], ranges[r][1] + 1) if o <= left and left - o + s.depth <= len(ctx)]
            if offs:
                w = np.array([xxhash.xxh3_64_intdigest(ctx[left - o : left - o + s.depth]) for o in offs], np.uint64).view(np.int64)
                k = len(offs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, ah, np.int32)), pa.array(np.full(k, ch, np.int64)), pa.array(np.full(k, n, np.int64)), pa.array(np.array(offs, np.int32)), pa.array(w)], ["ah", "ch", "n", "o", "w"])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are shuffled: (doc_id, th, size, z)."""
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([z.compress((t or "").encode("utf-8", "replace")) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "th", "size", "z"])


def _context_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The contexts asked for of each text: (ah, ch, left, n, ctx, g)."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            rows = []
            for raw, asked in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                raw = z.decompress(raw)
                for x in asked:
                    p = x["p"]
                    rows.append((x["ah"], x["ch"], min(p, s.reach), x["n"], raw[max(0, p - s.reach) : p + s.depth], x["g"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["ah", "ch", "left", "n", "ctx", "g"])


def removed_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs and what is left."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        a, b = max(0, a), min(len(raw), b)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        elif a < b:
            runs.append([a, b])
    left, at = [], 0
    for a, b in runs:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return sum(b - a for a, b in runs), len(runs), b"".join(left)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, packed, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = z.decompress(packed)
            n, k, kept = removed_bytes(raw, list(zip(a or (), b or (), strict=True)))
            rows.append((doc, len(raw), n, k, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"), F.octet_length(F.coalesce(text, F.lit(""))).alias("size"))


def _packed(docs: DataFrame, text: str) -> DataFrame:
    return _keyed(docs, text).mapInArrow(_small, "doc_id long, th long, size int, z binary")


def _contexts(docs: DataFrame, kinds: DataFrame, s: Settings, text: str) -> DataFrame:
    """(ah, ch, left, n, ctx): one context for each kind, cut from the text that stands for it."""
    need = kinds.select("ah", "ch", "n", "g", "rep.*").groupBy("doc_id", "th", "size").agg(F.collect_list(F.struct("ah", "ch", "n", "g", "p")).alias("x"))
    texts = _packed(docs, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    return texts.join(need, ["doc_id", "th", "size"]).select("z", "x").mapInArrow(lambda b: _context_rows(b, s), "ah int, ch long, left int, n long, ctx binary, g long").drop("g")


def _gathered(docs: DataFrame, kinds: DataFrame, s: Settings, text: str) -> DataFrame:
    """Spans (ah, ch, a, b) from buckets that a task can hold."""
    ctx = _contexts(docs, kinds, s, text)
    return ctx.repartition("ah").sortWithinPartitions("ah", "ch").mapInArrow(lambda b: _bucket_rows(b, s), "ah int, ch long, a int, b int")


def _counted(docs: DataFrame, kinds: DataFrame, s: Settings, text: str) -> DataFrame:
    """Spans (ah, ch, a, b) from larger buckets: digits are hashed where the contexts are and counted anywhere."""
    big = stored(_contexts(docs, kinds, s, text))
    cores = stored(big.mapInArrow(lambda b: _core_rows(b, s), "ah int, ch long, n long, r int, w long").distinct())
    # stored, as in spans: a join of an aggregate with its own input keeps a hot anchor's rows in one task
    alike = stored(cores.groupBy("ah", "r", "w").agg(F.count("*").alias("k")).where("k > 1").drop("k"))
    live = cores.join(alike, ["ah", "r", "w"]).groupBy("ah", "ch").agg(F.collect_set("r").alias("rs"))
    digits = stored(big.join(live, ["ah", "ch"]).select("ah", "ch", "left", "n", "ctx", "rs").mapInArrow(lambda b: _window_rows(b, s), "ah int, ch long, n long, o int, w long").distinct())
    twice = stored(digits.groupBy("ah", "o", "w").agg(F.count("*").alias("k")).where("k > 1").drop("k"))
    return digits.where("n = 1").join(twice, ["ah", "o", "w"]).groupBy("ah", "ch").agg((-F.max("o")).alias("a"), (F.lit(s.depth) - F.min("o")).alias("b"))


def spans(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """(th, size, a, b): of each text, by its hash and length, lists of begins and ends of spans to remove; texts without any are left out."""
    rows = stored(_keyed(docs, text).mapInArrow(lambda b: _anchor_rows(b, s), "ah int, ch long, doc_id long, th long, size int, p int"))
    # counts are stored, so that both sides of the joins on anchors are plain tables and a hot anchor's rows can be split
    more = stored(rows.groupBy("ah").agg(F.count("*").alias("c")).where("c > 1").select("ah"))
    rows = stored(rows.join(more, "ah"))
    each = stored(rows.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "size", "p")).alias("rep")))
    kinds = each.join(stored(each.groupBy("ah").agg(F.count("*").alias("g"))), "ah")
    found = _gathered(docs, kinds.where(F.col("g").between(2, s.bucket)), s, text)
    if not kinds.where(F.col("g") > s.bucket).isEmpty():
        found = found.unionByName(_counted(docs, kinds.where(F.col("g") > s.bucket), s, text))
    part = rows.join(found, ["ah", "ch"]).select("th", "size", (F.col("p") + F.col("a")).alias("a"), (F.col("p") + F.col("b")).alias("b"))
    whole = rows.join(each.where("n > 1").select("ah", "ch"), ["ah", "ch"]).select("th", "size", F.greatest(F.col("p") - s.reach, F.lit(0)).alias("a"), (F.col("p") + s.depth).alias("b"))
    flat = whole.unionByName(part).distinct()
    return flat.groupBy("th", "size").agg(F.collect_list(F.struct("a", "b")).alias("x")).select("th", "size", F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def dedup(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found = _packed(docs, text).join(spans(docs, s, text), ["th", "size"], "left").select("doc_id", "z", "a", "b")
    return found.mapInArrow(_results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
